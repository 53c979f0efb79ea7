"""Entities named in texts: extraction, normal form and quality, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, query_tokens, words

# What an entity looks like, the marks around it, and words that are none.
ENTITY = r"`[^`\n]{2,80}`|[A-Za-z][A-Za-z0-9_.:/#-]{1,63}"
MARKS = "`\"'.,:;()[]{}<>"
COMMON = (
    "the", "this", "that", "what", "which", "when", "where", "who", "why", "how", "does", "should", "could", "would", "user", "assistant", "and", "after", "with", "for", "from",
    "into", "owns", "uses", "used", "called", "returned", "then", "were", "was", "services", "service", "model", "models", "changes", "app", "architecture", "scope", "recall",
    "deploy", "deployment", "production", "command", "context", "tool", "tools", "execution", "summary", "output", "preview", "result", "results", "status", "success", "error",
    "path", "file", "files", "line", "lines", "json", "terminal", "patch", "todo", "browser", "session", "memory", "operator", "fact", "durable", "entity", "graph", "lookup",
    "profile", "current", "decision", "decisions", "appear", "appears", "through", "visible", "喜欢", "偏好", "希望", "临时", "配置", "使用", "路线图", "包含", "中文", "实体", "增强",
)
GENERIC = (
    "agent", "agents", "alert", "alerts", "current", "function", "functions", "helper", "helpers", "memory", "memories", "operation", "operations", "process", "processes",
    "service", "services", "state", "status", "system", "task", "tasks", "tool", "tools", "workflow", "workflows",
)
# What a piece of a Chinese sentence begins with, ends in or holds, but no name.
FRAGMENT_BEGINNINGS = ("所有", "当前", "目前", "最终", "任何", "这条", "这些")
FRAGMENT_ENDINGS = ("的", "时", "后", "前", "中", "上", "下", "与", "和", "或", "会", "让", "把", "被", "将", "都", "仍", "已")
FRAGMENT_MARKS = ("负责", "需要", "必须", "出现", "决定", "验证", "处理", "收口", "让模型", "交给", "等于", "淹没", "只负责", "最终", "所有", "当前", "目前")
CJK_NAME, CJK_LETTERS = r"^[\x{4e00}-\x{9fff}]+$", 8
FRAGMENT = f"^(?:{'|'.join(FRAGMENT_BEGINNINGS)})|(?:{'|'.join(FRAGMENT_ENDINGS)})$|{'|'.join(FRAGMENT_MARKS)}"
GENERIC_RELATION = (
    "active", "agent", "check", "cron", "digest", "live", "max", "medium", "memory", "minimal", "model", "msg", "none", "not", "plugin", "provider", "release",
    "telegram", "tool", "xhigh", "任务", "插件", "模型", "系统", "记忆", "配置",
)


def normal(entity: Column) -> Column:
    """Lower case, without marks around it, at most 96 letters."""
    return F.left(F.lower(F.regexp_replace(F.trim(F.trim(entity), F.lit(MARKS)), r"\s+", " ")), F.lit(96))


def indexable(entity: Column) -> Column:
    """Of a normal form: no identifier with an underscore, no path, not only generic words, and of Chinese letters alone no piece of a sentence."""
    generic = entity.rlike(f"^[^a-z]*(?:(?:{'|'.join(GENERIC)})(?:[^a-z]+|$))+$")
    piece = entity.rlike(CJK_NAME) & ((F.char_length(entity) > CJK_LETTERS) | entity.rlike(FRAGMENT))
    return (F.char_length(entity) >= 2) & ~F.contains(entity, F.lit("_")) & ~entity.rlike("^(?:/tmp/|/home/|file://)") & ~generic & ~piece


def unique(found: Column, most: int) -> Column:
    """The first entities among raw matches, in normal form, each once."""
    return F.slice(F.filter(F.array_except(F.transform(found, normal), words(COMMON)), indexable), 1, most)


def entities_of(content: str | Column, most: int = 12) -> Column:
    """The first entities of a text: names in back quotes and words of Latin letters, each once."""
    return unique(F.regexp_extract_all(F.coalesce(col(content), F.lit("")), F.lit(ENTITY), F.lit(0)), most)


def entities_of_query(query: str | Column, known: Column | None = None, most: int = 8) -> Column:
    """A question's entities: those of its text, and its words of three letters or more."""
    return unique(F.concat(entities_of(query), F.filter(query_tokens(query) if known is None else known, lambda t: F.char_length(t) >= 3)), most)


def distinctive(entity: Column) -> Column:
    """Specific enough to relate two memories."""
    letters = F.when(entity.rlike(r"[\x{4e00}-\x{9fff}]"), 2).otherwise(3)
    return (F.char_length(entity) >= letters) & ~F.array_contains(words(GENERIC_RELATION), entity) & ~entity.rlike("^[0-9]+$")
