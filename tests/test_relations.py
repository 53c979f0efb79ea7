"""Clauses written by hand from what the blueprint documents: what states a relation, what denies it, and whom it leaves out."""

import re

import pytest
from palimpsest.functions import entities
from palimpsest.operators import relate
from pyspark.sql import functions as F

STATED = {
    "depends_on": ["svc-a depends on svc-b", "svc-a requires svc-b", "svc-a 依赖于 svc-b"],
    "owned_by": ["svc-a is owned by team-b", "svc-a belongs to team-b", "svc-a 的负责人 team-b"],
    "affects": ["the release affects svc-b", "svc-a should not affect svc-b", "发布影响 svc-b"],
    "invalidates": ["the release invalidates svc-b", "svc-a shouldn't invalidate svc-b", "svc-b 失效"],
}
DENIED = {
    "depends_on": ["svc-a does not depend on svc-b", "svc-a shouldn't  require svc-b", "svc-a provides no runtime for svc-b", "it has no runtime role in svc-b", "svc-a no longer uses svc-b", "svc-a 无运行时依赖 svc-b", "svc-a is not part of svc-b"],
    "owned_by": ["svc-a is not maintained by team-b", "team-b is not on-call for it", "svc-a no longer belongs to team-b", "alice 并非 svc-a 的负责人", "svc-a 不再归属 team-b"],
    "affects": ["svc-a cannot change svc-b", "svc-b is unaffected by svc-a", "it has no impact on svc-b", "svc-b 不受 svc-a 影响", "svc-a 不会阻塞 svc-b"],
    "invalidates": ["svc-a won't make the policy of svc-b obsolete", "the policy is still valid", "it no longer makes the config obsolete", "svc-a 不会使 svc-b 失效", "svc-b 仍然有效"],
}
EXCLUDED = [
    ("svc-a depends on svc-b but not svc-c", ["svc-c"]), ("all of them except for the svc-c", ["svc-c"]), ("svc-b rather than svc-c", ["svc-c"]), ("影响范围不包括 svc-c", ["svc-c"]),
    ("依赖 svc-b 而非 svc-c", ["svc-c"]), ("依赖 svc-b 但不依赖 svc-c", ["svc-c"]), ("影响全部服务 svc-c 除外", ["svc-c"]), ("svc-c 不包括在内", ["svc-c"]), ("svc-a depends on svc-b", []),
]


@pytest.mark.parametrize("kind", STATED)
def test_denials(kind):
    assert [c for c in STATED[kind] if re.search(relate.DENIALS[kind], c)] == []
    assert [c for c in DENIED[kind] if not re.search(relate.DENIALS[kind], c)] == []


@pytest.mark.parametrize("clause, out", EXCLUDED)
def test_exclusions(clause, out):
    assert [m for p in relate.EXCLUDED for m in re.findall(p, clause)] == out


def test_mentions(spark):
    """The whole extraction over notes: stated, denied, excluded."""
    rows = [("1", "s", "svc-a depends on svc-b but not svc-c. svc-a provides no runtime for svc-d"), ("2", "s", "svc-b is healthy and available"), ("3", "s", "svc-a 依赖 svc-b, svc-e 除外")]
    found = relate.mentions(spark.createDataFrame(rows, "id string, scope_id string, content string")).where("relation = 'depends_on' AND role = 'source'")
    got = {(r["id"], r["entity"]) for r in found.collect() if r["entity"].startswith("svc")}
    assert got - {("3", "svc-a")} == {("1", "svc-b"), ("3", "svc-b")}


NAMES = ["北京机房", "svc-a", "数据中心", "chrome浏览器的"]  # of mixed letters anything goes
PIECES = ["所有机房", "机房需要缓存", "机房的", "目前", "运行在北京朝阳区的主机", "由系统处理", "services", "/tmp/x", "a_b"]


def test_names_and_pieces_of_sentences(spark):
    frame = spark.createDataFrame([(e,) for e in NAMES + PIECES], "e string")
    assert [r["e"] for r in frame.where(entities.indexable(F.col("e"))).collect()] == NAMES
    text = spark.createDataFrame([("见 `北京机房` 和 `当前机房的`, svc-a",)], "t string")
    assert text.select(entities.entities_of("t")).first()[0] == ["北京机房", "svc-a"]
