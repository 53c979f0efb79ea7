"""An import plan by hand: what comes in, what stays out and why, and what is hidden from whoever reads the plan."""

from palimpsest.sources import files

ROWS = [
    ("1", " Alice prefers tea ", "work", " User ", "2024-01-01", None), ("2", "  ", "work", "memory", None, None), ("3", "kept", None, None, None, None), ("4", "odd", "work", "elsewhere", None, None),
    ("5", "User: hi\nsome words\nAssistant: hello", "work", "memory", None, None), ("6", "password = hunter2 in /home/al/x", "work", "ops", None, '{"k": 1}'), ("7", "old one", "work", "memory", None, None), ("8", "The user: is he here?", "work", "memory", None, None),
    ("9", None, "work", "memory", None, None), ("6", "password = hunter2 in /home/al/x", "work", "ops", None, '{"k": 1}'),
]


def test_plan(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], "id string, text string, scope string, category string, timestamp string, metadata string, outcome string")
    none = spark.createDataFrame([], "fingerprint string")
    known = files.import_plan(rows, none, "old").where("row_id = '7'").select("fingerprint")
    got = sorted(files.import_plan(rows, known.union(known), "old").collect(), key=lambda r: (r["row_id"], r["outcome"]))
    want = [("1", "importable"), ("2", "empty"), ("3", "importable"), ("4", "target_not_allowed"), ("5", "raw_transcript"), ("6", "importable"), ("6", "repeated"), ("7", "already_imported"), ("8", "importable"), ("9", "empty")]
    assert [(r["row_id"], r["outcome"]) for r in got] == want
    by = {r["row_id"]: r for r in got}
    assert (by["1"]["content"], by["1"]["target"], by["1"]["scope_id"], by["3"]["target"], by["3"]["scope_id"]) == ("Alice prefers tea", "user", "old|work", "memory", "old|unknown")
    assert by["6"]["findings"] == ["secret_like", "path_like"] and "hunter2" not in by["6"]["snippet"] and "/home/al" not in by["6"]["snippet"] and by["1"]["findings"] == []
    assert len({r["fingerprint"] for r in got}) == 9 and all(r["id"] == f"imported:{r['fingerprint']}" for r in got)
    assert files.import_plan(rows.limit(0), none, "old").count() == 0
