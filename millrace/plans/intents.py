"""Structured intents before planning: phrases against names of columns, resolution with a margin, validation in passes.

A draft comes from outside (a form, a model). Each pass looks at one side of it, repairs what has one sound repair, and
lists the rest: names, meaning, types, executability. What is left compiles, or the draft is refused.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from millrace.plans.ir import AGGREGATIONS, Filter, Metric, Order, QueryError, QueryIR, normalise
from millrace.plans.language import BUSINESS_TERMS, QUESTION_WORDS
from millrace.plans.planner import TableInfo, singular, words_of

#: Least likeness of a phrase to a name, and how much nearer than the next name it must be.
LIKE, MARGIN, PERHAPS = 0.84, 0.05, 0.6

# Words of a question and of a column by the subject they belong to.
QUESTION_SUBJECTS = {
    "academic": ("score", "grade", "student", "test", "exam", "math", "english", "subject", "course"),
    "financial": ("revenue", "profit", "cost", "price", "sales", "payment", "amount", "balance"),
    "sales": ("order", "product", "customer", "quantity", "sold", "purchase"),
    "customer": ("customer", "user", "client", "member", "account"),
    "temporal": ("year", "month", "day", "date", "time", "period"),
}
COLUMN_SUBJECTS = {
    "academic": ("score", "grade", "gpa", "test", "exam", "subject", "mark"),
    "financial": ("revenue", "profit", "cost", "price", "amount", "balance", "salary", "fee"),
    "sales": ("order", "product", "quantity", "qty", "sold", "purchase"),
    "customer": ("customer", "user", "client", "member", "account"),
    "temporal": ("year", "month", "day", "date", "time", "created", "updated"),
}
GROUPING_WORDS = ("by", "per", "each", "grouped", "breakdown", "across")

_SKIP = frozenset(QUESTION_WORDS) | frozenset(BUSINESS_TERMS) | frozenset(("the", "of", "in", "for", "a", "an", "and", "or", "with", "from", "is", "are", "over", "under", "many", "much", "all", "most", "least"))


def subject(text: str, subjects: dict[str, tuple[str, ...]]) -> str | None:
    """The first subject one of whose words the text holds."""
    low = text.lower()
    return next((s for s, words in subjects.items() if any(w in low for w in words)), None)


def _names(tables: list[TableInfo]) -> dict[str, tuple[str, str]]:
    """Spelled-out names of columns -> (table, column); the first table that has a name keeps it."""
    out: dict[str, tuple[str, str]] = {}
    for t in tables:
        for c in t.columns:
            for alias in (c.name.lower(), " ".join(re.split(r"[^a-z0-9]+", c.name.lower())).strip()):
                out.setdefault(alias, (t.name, c.name))
    return out


def _near(phrase: str, names: list[str]) -> list[tuple[float, str]]:
    return sorted(((difflib.SequenceMatcher(None, phrase, n).ratio(), n) for n in names), reverse=True)[:2]


def correct_phrases(text: str, tables: list[TableInfo]) -> tuple[str, list[tuple[str, str]]]:
    """Replace phrases of three, two or one words that nearly spell a whole name of a column; longer phrases first.

    A phrase may not begin or end with a word of questions, and no two names may be about as near. Returns the text and
    the replacements.
    """
    names = _names(tables)
    words = re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+", text)
    at = [i for i, w in enumerate(words) if re.match(r"[A-Za-z0-9_]", w)]
    done: set[int] = set()
    changes: list[tuple[str, str]] = []
    for span in (3, 2, 1):
        for k in range(len(at) - span + 1):
            places = at[k : k + span]
            part = [words[i].lower() for i in places]
            phrase = " ".join(part)
            if done & set(places) or len(phrase) < 4 or part[0] in _SKIP or part[-1] in _SKIP or phrase in names:
                continue
            near = _near(phrase, [n for n in names if "_" not in n])
            if not near or near[0][0] < LIKE or (len(near) > 1 and near[0][0] - near[1][0] < MARGIN):
                continue
            name = names[near[0][1]][1]
            words[places[0]] = name
            for i in range(places[0] + 1, places[-1] + 1):
                words[i] = ""
            done.update(places)
            changes.append((phrase, name))
    return "".join(words), changes


@dataclass(frozen=True)
class Resolution:
    phrase: str
    outcome: str
    table: str | None = None
    column: str | None = None
    likeness: float = 0.0
    candidates: tuple[str, ...] = ()


def resolve(phrase: str, tables: list[TableInfo]) -> Resolution:
    """``matched`` (by name, singular or near spelling), ``ambiguous`` (several names are about as near) or ``unmatched``."""
    names = _names(tables)
    low = " ".join(words_of(phrase))
    if low in names:
        return Resolution(phrase, "matched", *names[low], 1.0)
    stems = " ".join(singular(w) for w in low.split())
    same = [n for n in names if " ".join(singular(w) for w in re.split(r"[^a-z0-9]+", n)) == stems]
    if same:
        return Resolution(phrase, "matched", *names[same[0]], 0.99)
    holding = sorted({names[n][1] for n in names if stems in [singular(w) for w in re.split(r"[^a-z0-9]+", n)]})
    if len(holding) > 1:
        return Resolution(phrase, "ambiguous", likeness=0.9, candidates=tuple(holding))
    if holding:
        return Resolution(phrase, "matched", next(t.name for t in tables if t.get(holding[0])), holding[0], 0.9)
    pool: dict[str, tuple[str, str]] = {}
    for n, where in names.items():
        for part in (n, *re.split(r"[^a-z0-9]+", n)):
            pool.setdefault(part, where)
    near = [x for x in _near(low, list(pool)) if x[0] >= PERHAPS]
    if not near:
        return Resolution(phrase, "unmatched")
    if len(near) > 1 and near[0][0] - near[1][0] <= MARGIN and pool[near[0][1]] != pool[near[1][1]]:
        return Resolution(phrase, "ambiguous", likeness=near[0][0], candidates=tuple(pool[n][1] for _, n in near))
    return Resolution(phrase, "matched", *pool[near[0][1]], near[0][0])


def metric_fit(column: str, question: str) -> int:
    """How well a column fits a question: words in common, the subject, and ids that are not asked for."""
    words = set(words_of(question))
    parts = set(re.split(r"[^a-z0-9]+", column.lower()))
    asked, own = subject(question, QUESTION_SUBJECTS), subject(column, COLUMN_SUBJECTS)
    score = 10 * len({singular(p) for p in parts} & {singular(w) for w in words})
    score += 10 if asked and own == asked else -20 if asked and own else 0
    return score - (3 if column.lower().endswith("_id") and "id" not in words else 0)


@dataclass
class Report:
    """Outcome of the passes: the intent as repaired, and what was found."""

    intent: dict
    problems: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    repairs: list[str] = field(default_factory=list)
    casts: dict[str, str] = field(default_factory=dict)
    ir: QueryIR | None = None

    @property
    def valid(self) -> bool:
        return not self.problems


def _names_pass(question: str, r: Report, t: TableInfo) -> None:
    """Columns must exist; dimensions, filters and orders on others are dropped, a metric on another is a problem."""
    names = {c.name for c in t.columns}
    for m in r.intent["metrics"]:
        if m.get("column") != "*" and m.get("column") not in names:
            r.problems.append(f"unknown metric {m.get('column')}")
        if str(m.get("aggregation") or "SUM").upper() not in AGGREGATIONS:
            r.problems.append(f"unknown aggregation {m.get('aggregation')}")
    made = names | {m.get("alias") for m in r.intent["metrics"]} | {f"{str(m.get('aggregation') or '').lower()}_{m.get('column')}" for m in r.intent["metrics"]}
    for part, known, of in (("dimensions", names, lambda x: x), ("filters", names, lambda x: x.get("column")), ("order_by", made, lambda x: x.get("column"))):
        kept = [x for x in r.intent[part] if of(x) in known]
        r.repairs += [f"dropped {part} on {of(x)}" for x in r.intent[part] if of(x) not in known]
        r.intent[part] = kept


def _meaning_pass(question: str, r: Report, t: TableInfo) -> None:
    """Subjects must agree, grouping words need dimensions, and text values must stand in the question."""
    low = question.lower()
    asked = subject(question, QUESTION_SUBJECTS)
    for m in r.intent["metrics"]:
        own = subject(m["column"], COLUMN_SUBJECTS)
        if asked and own and asked != own and metric_fit(m["column"], question) < 0:
            better = max(t.numeric, key=lambda c: metric_fit(c.name, question), default=None)
            if better and metric_fit(better.name, question) > 0:
                r.repairs.append(f"{m['column']} is about {own}, took {better.name}")
                m["column"] = better.name
            else:
                r.problems.append(f"{m['column']} is about {own}, the question about {asked}")
    grouped = bool(set(words_of(question)) & set(GROUPING_WORDS))
    if grouped != bool(r.intent["dimensions"]):
        r.warnings.append("grouping words without dimensions" if grouped else "dimensions without grouping words")
    kept = []
    for f in r.intent["filters"]:
        values = f["value"] if isinstance(f["value"], (list, tuple)) else [f["value"]]
        if all(not isinstance(v, str) or str(v).lower().strip("%") in low for v in values):
            kept.append(f)
        else:
            r.repairs.append(f"dropped a filter on {f['column']} that the question does not hold")
    r.intent["filters"] = kept


def _types_pass(question: str, r: Report, t: TableInfo) -> None:
    """Numbers are aggregated and compared as numbers: texts are counted, or cast where their name says they hold numbers."""
    for m in r.intent["metrics"]:
        c = t.get(m["column"]) if m["column"] != "*" else None
        if c and not c.numeric and str(m.get("aggregation") or "").upper() in ("SUM", "AVG"):
            if subject(c.name, COLUMN_SUBJECTS) in ("academic", "financial"):
                r.casts[c.name] = "double"
                r.repairs.append(f"cast {c.name} to a number")
            else:
                m["aggregation"] = "COUNT"
                r.repairs.append(f"{c.name} is text and is counted")
    for f in r.intent["filters"]:
        c = t.get(f["column"])
        if c and c.numeric and isinstance(f["value"], str):
            try:
                f["value"] = float(f["value"]) if "." in f["value"] else int(f["value"])
                r.repairs.append(f"value of {c.name} read as number")
            except ValueError:
                r.problems.append(f"{c.name} is a number, {f['value']!r} is none")


def _executable_pass(question: str, r: Report, t: TableInfo) -> None:
    """The intent must compile against the schema."""
    i = r.intent
    limit = i.get("limit") or (1 if i["order_by"] else None)
    try:
        ir = QueryIR(
            t.name, tuple(Metric(m["column"], str(m.get("aggregation") or ("COUNT" if m["column"] == "*" else "SUM")).upper(), m.get("alias")) for m in i["metrics"]) or (Metric("*", "COUNT"),), tuple(i["dimensions"]),
            tuple(Filter(f["column"], f.get("operator", "="), f["value"]) for f in i["filters"]), order_by=tuple(Order(o["column"], str(o.get("direction") or "DESC").upper()) for o in i["order_by"]), limit=limit, casts=r.casts,
        )
        schema = T.StructType([T.StructField(c.name, T.DoubleType() if c.numeric else T.StringType()) for c in t.columns])
        r.ir = normalise(ir, schema)
    except (QueryError, TypeError, KeyError) as e:
        r.problems.append(f"does not compile: {e}")


def validate(question: str, draft: dict, tables: list[TableInfo]) -> Report:
    """Run all passes over a draft (``table, metrics, dimensions, filters, order_by, limit``); later ones only while it is sound."""
    parts = {k: [dict(x) if isinstance(x, dict) else x for x in draft.get(k) or []] for k in ("metrics", "dimensions", "filters", "order_by")}
    r = Report({**draft, **parts})
    t = next((t for t in tables if t.name == str(draft.get("table") or "").rsplit(".", 1)[-1]), None)
    if t is None:
        r.problems.append(f"unknown table {draft.get('table')}")
        return r
    for step in (_names_pass, _meaning_pass, _types_pass, _executable_pass):
        step(question, r, t)
        if r.problems:
            return r
    return replace(r)
