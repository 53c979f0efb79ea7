"""What digests may keep: quality and pollution of candidates, admission, and whether a quote supports a claim."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

def phrase(words: str) -> str:
    """A pattern of a phrase: any white space for a space, a number for #, up to 40 letters of a line for an ellipsis."""
    out = re.sub(r"([.\\\[\](){}*+?^$|])", r"\\\1", words)
    return out.replace(" … ", r"\b[^\n]{0,40}\b").replace("…", r"[^\n]{0,40}").replace("#", r"\d+").replace(" ", r"\s+")


def said(words: tuple[str, ...] = (), cjk: tuple[str, ...] = (), shapes: tuple[str, ...] = (), case: bool = False) -> str:
    """One pattern of any of these: whole words and phrases, CJK phrases wherever they stand, and shapes that no list of phrases gives."""
    latin = rf"\b(?:{'|'.join(map(phrase, words))})\b" if words else ""
    return ("" if case else "(?i)") + "|".join(x for x in (latin, *map(phrase, cjk), *shapes) if x)


# What is progress talk, a raw trace, a trigger, a check, a step or a chain of tools in a digest candidate.
TRANSIENT = said(("progress update",), ("进度", "停服维护进度", "用了哪些工具", "使用了哪些工具", "工具流水", "本轮进度", "本轮操作", "当前进度"))
RAW_TRACE = said(
    ("tool_calls", "tool_call_id", "Command hints", "git -C"),
    ("Traceback (most recent call last)", "[OUT-OF-BAND", "image_cache/img_", ".pytest_cache", "__pycache__", "关键命令/检查"),
    (r'"output"\s*:', r"call_[A-Za-z0-9]{8,}", r"(?:/home|/Users|/root)/\S+", r"(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/]\S+", r"\\\\[^\\/\s]+[\\/]\S+", r"%(?:TEMP|TMP|LOCALAPPDATA|APPDATA|USERPROFILE)%[\\/]\S+"),
)
TRIGGER = said((), ("触发", "当", "如果", "遇到", "流程", "步骤", "修复", "验证", "发布", "部署", "审计", "排障", "任务", "问题", "报错", "bug", "release", "deploy", "debug", "journal", "digest"))
VERIFIED = said((), ("# passed", "release gate ok", "pyright…0 errors", "ruff…passed", "ok=true", "验证通过", "验证命令", "验证结果", "实测", "smoke", "doctor…ok", "pytest"))
STEPS = said((), ("步骤", "先…再", "1.", "1)", "1、", "2.", "2)", "2、", "坑点", "注意", "回滚", "清理", "验证"))
TOOLCHAIN = said((), ("使用工具链", "tool-chain", "tools_used"))
# States of tasks, tests and repositories, and old snapshots, that no memory should keep.
_COLON = r"\s*[:：]"
POLLUTION = {
    "task_state_snapshot": said(
        ("PLAN_STATE", "last_completed_task", "current_task", "current_phase", "next_action"), (),
        (r"\bT\d{1,3}[-_:][^\n]{0,80}\b(?:complete|completed|pending|in[ _-]?progress)\b", *(w + _COLON for w in ("当前任务", "当前阶段", "下一步", "待办", "任务进度"))),
    ),
    "test_run_snapshot": said(
        tuple(f"{n}{state}" for n in ("# ", "# test ", "# tests ") for state in ("passed", "failed", "skipped", "warning", "warnings")) + tuple(f"{run} … {state}" for run in ("pytest", "test suite", "test", "tests") for state in ("passed", "failed", "green", "red")), (),
        tuple(rf"{run}[^\n]{{0,24}}{state}" for run in ("测试", "用例") for state in ("通过", "失败", "全绿")),
    ),
    "repository_audit_snapshot": said(
        tuple(f"{where} … {state}" for where in ("git status", "worktree") for state in ("clean", "dirty")) + tuple(f"{kind}{gap}#" for kind in ("PR", "issue", "release") for gap in ("", " ")), (),
        (r"\b(?:commit|commit\s+sha|HEAD)\s*[:=]?\s*[0-9a-f]{7,40}\b", r"\b(?:branch|tag)\s*[:=]\s*[^\s,;]+", r"\b(?:PR|issue|release)\s*[#]\d+\b"),
    ),
    "historical_snapshot": said((), ("historical task snapshot", "context compaction", "prior context", "conversation summary for continuation", "历史任务快照", "上下文压缩", "旧快照"), (r"截至\s*\d{4}[-/年]\d{1,2}",)),
}
#: A rule that tests must pass.
NORMATIVE_GATE = r"(?i)(?:" + said(("require", "requires", "required", "must", "minimum", "at least", "gate"), ("要求", "必须", "至少", "门槛", "准入"), case=True) + r")[^\n]{0,80}(?:" + said(("# passed", "# test passed", "# tests passed"), case=True) + r"|(?:测试|用例)[^\n]{0,20}(?:通过|全绿))"
# The present, what changes soon, and rules about it.
CURRENT = said(("current", "currently", "online", "live", "running", "now"), ("当前", "目前", "现状", "在线", "运行中", "已切换", "现已", "仍为", "持续"))
VOLATILE = said(
    ("NOGO", "NO-GO", "NO GO", "GO", "enabled", "disabled", "active", "inactive", "failed", "model", "provider", "version", "branch", "commit", "endpoint", "status", "state"), ("端口", "模型", "供应商", "版本", "分支", "提交", "状态", "候选"),
    (r"\b(?:PID|port)\s*[=:]?\s*\d+\b", r"\b\d+\.\d+(?:\.\d+)?(?:[-.]?[A-Za-z0-9]+)?\b"),
)
NORMATIVE = said(("must", "should", "require", "requires", "required"), ("必须", "禁止", "不得", "应该", "应当", "需要", "要求"))
SUCCESS = said(("passed", "success", "succeeded", "green", "fixed"), ("通过", "成功", "已修复"))
FAILURE = said(("failed", "failure", "error", "blocked", "red"), ("失败", "报错", "阻塞"))
DIRECT_SOURCES = ("direct_user", "direct_user_correction", "manual_correction", "user_message")
CORROBORATING_SOURCES = ("document", "external_record", "tool_result", "verified_profile")

# A lexicon of tense and stance.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SEASONS = ("spring", "summer", "autumn", "fall", "winter")
SPANS = ("day", "week", "month", "quarter", "semester", "year")
COUNTS = ("a", "an", "one", "two", "three", "four", "five", "six", "ten", "a few", "several", "some", "another", "half a", "#")
CONDITIONAL = said(("if", "unless", "assuming", "provided that", "would", "could"), ("如果", "除非", "假如", "若", "可能会"), case=True)
FUTURE = said(("will", "shall", "tomorrow", "later", "plan to", "plans to", "intend to", "intends to", "going to", *(f"next {s}" for s in SPANS)), ("将会", "将要", "明天", "下周", "下个月", "明年", "以后", "计划"), case=True)
TEMPORARY = said(
    ("temporary", "temporarily", "for now", "for the time being", "until", "short-term", "short term", "fixed-term", "fixed term", "on vacation", "on a trip", "on contract", "on a contract", "seasonal", "seasonally", "on probation",
     *(f"{w} {s}" for s in SEASONS for w in ("this", "for the", "over the", "during the")), *(f"{w} {m}" for m in MONTHS for w in ("in", "during", "through")), *(f"from {m} to {n}" for m in MONTHS for n in MONTHS)),
    ("暂时", "临时", "短期", "度假", "出差", "直到", "合同期", "实习期间", "暑假", "寒假", "为期"),
    (rf"\bfor\s+(?:{'|'.join(map(phrase, COUNTS))}|the\s+next|the\s+rest\s+of\s+the)(?:\s+(?:{'|'.join(map(phrase, COUNTS))}))?[\s-]+(?:{'|'.join(SPANS)})s?\b", r"\bfor\s+(?:days|weeks|months|years)\b"),
    case=True,
)
PAST = said(
    ("used to", "formerly", "previously", "yesterday", "ago", "worked", "lived", "resided", "stayed", "preferred", "liked", "used", "had", "was", "were", "did work", "did live", "did prefer", "did use", *(f"last {s}" for s in (*SPANS, *SEASONS)), *(f"{h} been" for h in ("has", "have"))),
    ("曾经", "以前", "过去", "原来", "去年", "昨天", "当时", "之前", "此前"), (r"\bin\s+(?:19|20)\d{2}\b",), case=True,
)
PRESENT = said(("currently", "presently", "now", "still", "today", "at present"), ("现在", "目前", "如今", "当前", "现时", "仍然", "一直"), case=True)
_TURNS = ("start", "stop", "finish", "end", "join", "move", "relocate", "switch", "resume", "pause", "leave", "quit", "begin")
TRANSITION = said(
    (*_TURNS, "started", "stopped", "finished", "ended", "joined", "moved", "relocated", "switched", "resumed", "paused", "left", "began", "begun", "starting", "stopping", "finishing", "ending", "joining", "moving", "relocating", "switching", "resuming", "pausing", "leaving"),
    ("开始", "停止", "结束", "恢复", "暂停", "离开", "离职", "加入", "搬到"), case=True,
)
NEGATED = said(("not", "never", "no longer", "without", "neither", "nor", "cannot", *(f"{v}n't" for v in ("ca", "could", "did", "does", "do", "has", "is", "are", "was", "were", "wo", "would"))), ("不再", "并不", "从不", "没有", "不是", "并非", "无法", "不能", "不会", "否认"), case=True)
UNSURE = said(("may", "might", "perhaps", "possibly", "probably", "guess", "unverified", "uncertain", "rumored", "rumoured", "apparently", "seem", "seems", "maybe"), ("可能", "也许", "或许", "猜测", "似乎", "据称", "据说"), case=True)
RETRACTED = said(
    ("no longer", "not", "never", "left", "leave", "leaving", "quit", "stop", "stopped", "end", "ended", "incorrect", "wrong", "false", "retract", "retracted", "retraction", "withdraw", "withdrawn"),
    ("不再", "已经离开", "已离开", "离职", "停止", "结束", "错误", "不正确", "撤回", "作废"), case=True,
)
#: Whom a clause quotes: what somebody says is theirs and not known.
ATTRIBUTED = said(("according to", "claims that", "claimed that", "says that", "said that", "heard that", "told me that", "reportedly", "allegedly"), ("据", "听说", "声称", "转述"), case=True)


def digest_action(content: str | Column, memory_type: Column, confidence: Column) -> Column:
    """What becomes of a digest candidate: reject, candidate or promote."""
    t = col(content)
    verified = t.rlike(VERIFIED)
    reusable = t.rlike(TRIGGER) & (verified | t.rlike(STEPS)) & ~t.rlike(TRANSIENT) & ~t.rlike(RAW_TRACE)
    return (
        F.when(t.rlike(RAW_TRACE) | t.rlike(TRANSIENT) | (t.rlike(TOOLCHAIN) & ~verified), "reject")
        .when(memory_type.isin("workflow", "procedure", "pitfall") & reusable, "promote")
        .when((memory_type == "summary") | (confidence < 0.55), "candidate")
        .when(reusable | verified, "promote")
        .otherwise("candidate")
    )


def pollution(content: str | Column, memory_type: Column) -> Column:
    """The reasons for which a candidate stays out of recall. A rule that tests must pass is no test run."""
    t = col(content)
    gate = memory_type.isin("procedure", "workflow", "constraint") & t.rlike(NORMATIVE_GATE)
    marks = [F.when(t.rlike(p) & (~gate if name == "test_run_snapshot" else F.lit(True)), name) for name, p in POLLUTION.items()]
    return F.array_compact(F.array(*marks))


def slot_conflicts(slot: str | list[str], value: str) -> Column:
    """Whether a batch has several values for one single-valued slot. Use over a window of the slot's rows."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*([slot] if isinstance(slot, str) else slot))
    return F.min(value).over(w) != F.max(value).over(w)


def time_sensitive(content: str | Column) -> Column:
    """A sentence that states something volatile of the present, unless it says what must be."""
    sentences = F.split(F.coalesce(col(content), F.lit("")), r"[。！？!?;；\n]+")
    return F.exists(sentences, lambda s: s.rlike(CURRENT) & s.rlike(VOLATILE) & ~s.rlike(NORMATIVE))


def admission(content: str | Column, memory_type: Column, lifecycle: Column) -> Column:
    """(route, lifecycle, status) under which an automatic candidate is stored."""
    snapshot = time_sensitive(content)
    route = F.when(memory_type.isin("procedure", "workflow", "pitfall"), "experience_review").otherwise("memory_review")
    state = F.when(snapshot, "candidate").when(lifecycle.isin("candidate", "promoted"), lifecycle).otherwise("candidate")
    status = F.when(state == "promoted", "promoted").when(snapshot, "needs_live_check").otherwise("needs_review")
    return F.struct(route.alias("route"), state.alias("lifecycle"), status.alias("status"))


def durable_class(clause: Column) -> Column:
    """Whether a clause speaks of what lasts: conditional, future, temporary, past, current_durable or unknown."""
    c = F.lower(clause)
    return (
        F.when(c.rlike(CONDITIONAL), "conditional").when(c.rlike(FUTURE), "future").when(c.rlike(TEMPORARY), "temporary").when(c.rlike(PAST), "past")
        .when(c.rlike(PRESENT), "current_durable").otherwise("unknown")
    )


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def _frames(quote: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """The clauses that hold subject, predicate and value in this order, with the value blotted out."""
    clauses = F.transform(F.split(F.lower(quote), r"[.;!?。！？；\n]+|\b(?:but|however|although|though)\b|但是|不过|然而|可是"), lambda s: F.trim(s))
    edge = lambda x: F.concat(F.lit(r"(?<!\w)"), _quoted(F.lower(x)), F.lit(r"(?!\w)"))
    ordered = F.concat(edge(subject), F.lit(".*"), edge(predicate), F.lit(".*"), edge(value))
    return F.transform(F.filter(clauses, lambda c: F.regexp_like(c, ordered)), lambda c: F.regexp_replace(c, edge(value), F.lit(" ")))


def supports(quote: Column, source_type: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """A quote of an authoritative source says in one clause, affirmed and of the present, that the claim holds.

    The predicate has to stand as it is; a present form in s or an auxiliary, or a word for the present, is needed.
    """
    present = predicate.rlike(r"(?i)^(?:am|is|are|has|have)\b|^\w+[^s\W]s\b")
    good = lambda c: ~c.rlike(NEGATED) & ~c.rlike(UNSURE) & ~c.rlike(ATTRIBUTED) & ~c.rlike(TRANSITION) & durable_class(c).isin("current_durable", "unknown") & (present | c.rlike(PRESENT))
    return source_type.isin(*DIRECT_SOURCES, *CORROBORATING_SOURCES) & F.exists(_frames(quote, subject, predicate, value), good)


def retracts(quote: Column, source_type: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """A quote of an authoritative source takes the claim back in one clause that is no guess and no condition."""
    plain = lambda c: ~c.rlike(UNSURE) & ~c.rlike(ATTRIBUTED) & ~durable_class(c).isin("conditional", "future", "temporary")
    return source_type.isin(*DIRECT_SOURCES, *CORROBORATING_SOURCES) & F.exists(_frames(quote, subject, predicate, value), lambda c: plain(c) & c.rlike(RETRACTED))
