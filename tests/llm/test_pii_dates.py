from gristmill.llm import pii


def test_day_first_dates_with_hyphens(spark):
    rows = [(1, "born 12-05-1987."), (2, "born 12/05/1987."), (3, "ssn 123-45-6789"), (4, "31-02-1987")]
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [got[i]["n_date"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and got[3]["n_ssn"] == 1
    assert "12-05-1987" not in got[1]["text"] and got[1]["text"] == got[2]["text"].replace("/", "-")
    assert got[4]["text"] == "31-02-1987"
