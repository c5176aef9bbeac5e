"""Questions before planning: what kind of input it is, cleaning, spelling against the schema, business terms, review."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from millrace.plans.ir import QueryIR
from millrace.plans.planner import TableInfo, is_predictive, match_column, mentions, singular, words_of

#: Fillers, small talk and words of questions.
FILLERS = ("um", "uh", "erm", "hmm", "like", "please", "kindly", "basically", "actually", "literally", "okay", "ok", "so", "well", "just")
SMALL_TALK = ("hello", "hi", "hey", "thanks", "thank", "bye", "good", "morning", "evening", "how", "are", "you", "who")
QUESTION_WORDS = ("what", "which", "show", "list", "how", "many", "count", "top", "highest", "lowest", "average", "total", "sum", "compare", "give", "display", "forecast", "predict", "trend", "between", "per", "by")
# Business terms that stand for a term of the planner.
BUSINESS_TERMS = {"impact": "relationship", "effect": "relationship", "influence": "relationship", "relation": "relationship"}
#: Words of users for terms of a schema; taken only where the schema has the term and lacks the word.
SYNONYMS = {"turnover": "revenue", "income": "revenue", "clients": "customers", "client": "customer", "buyers": "customers", "purchases": "orders", "purchase": "order", "headcount": "population", "earnings": "revenue", "qty": "quantity", "amt": "amount"}


def classify_input(text: str | None) -> str:
    """``empty, noise, numeric, conversational, predictive, analytical`` or ``unclear``."""
    t = (text or "").strip()
    if not t:
        return "empty"
    if re.fullmatch(r"[\d\s.,%+-]+", t):
        return "numeric"
    words = re.findall(r"[^\W\d_]+", t.lower())
    letters = sum(ch.isalpha() for ch in t)
    if not words or letters < 0.4 * len(t.replace(" ", "")) or all(len(set(w)) <= 2 and len(w) > 3 for w in words):
        return "noise"
    if is_predictive(t):
        return "predictive"
    if any(re.search(rf"\b{w}\b", t.lower()) for w in QUESTION_WORDS if w not in SMALL_TALK):
        return "analytical"
    if set(words) <= set(SMALL_TALK) | {"there", "the", "is", "it"}:
        return "conversational"
    return "unclear"


def segment(run: str, vocabulary: set[str], costs: dict[str, float] | None = None) -> list[str]:
    """Split letters run together into known words: fewest unknown letters, then fewest words."""
    best: list[tuple[tuple[float, int], list[str]]] = [((0.0, 0), [])]
    longest = max(map(len, vocabulary), default=1)
    for i in range(1, len(run) + 1):
        options = []
        for j in range(max(0, i - longest), i):
            w = run[j:i]
            if w in vocabulary:
                cost, words = best[j]
                options.append(((cost[0], cost[1] + 1), [*words, w]))
        cost, words = best[i - 1]
        tail = [*words[:-1], words[-1] + run[i - 1]] if words and words[-1] not in vocabulary else [*words, run[i - 1]]
        options.append(((cost[0] + 1, cost[1]), tail))
        best.append(min(options, key=lambda o: o[0]))
    return best[-1][1]


def clean_question(text: str, vocabulary: set[str] | None = None) -> str:
    """Without fillers and repeated words; long unknown words are split where known words make them up."""
    out: list[str] = []
    for w in re.findall(r"\S+", text):
        bare = w.lower().strip(",.!?;:")
        if bare in FILLERS or (out and out[-1].lower().strip(",.!?;:") == bare):
            continue
        if vocabulary and len(bare) > 9 and bare.isalpha() and bare not in vocabulary:
            parts = segment(bare, vocabulary)
            if len(parts) > 1 and all(p in vocabulary for p in parts):
                out.extend(parts)
                continue
        out.append(w)
    return " ".join(out)


def schema_words(tables: list[TableInfo]) -> set[str]:
    return {w for t in tables for c in t.columns for w in re.split(r"[^a-z0-9]+", c.name.lower()) if len(w) > 2}


def correct_spelling(text: str, tables: list[TableInfo], cutoff: float = 0.84) -> tuple[str, list[tuple[str, str]]]:
    """Replace words that nearly spell a word of the schema, unless two words are about as near."""
    vocabulary = sorted(schema_words(tables))
    stems = {singular(v) for v in vocabulary}
    changes: list[tuple[str, str]] = []

    def fix(m: re.Match) -> str:
        w = m[0].lower()
        if len(w) < 4 or singular(w) in stems or w in QUESTION_WORDS:
            return m[0]
        near = sorted(((difflib.SequenceMatcher(None, w, v).ratio(), v) for v in vocabulary if abs(len(v) - len(w)) <= 3), reverse=True)
        if not near or near[0][0] < cutoff or (len(near) > 1 and near[0][0] - near[1][0] < 0.05):
            return m[0]
        changes.append((m[0], near[0][1]))
        return near[0][1]

    return re.sub(r"[A-Za-z]+", fix, text), changes


def business_terms(text: str, tables: list[TableInfo]) -> str:
    """Replace business terms, and synonyms by the terms of the schema where the schema has the term and lacks the synonym."""
    known = schema_words(tables)
    stems = known | {singular(k) for k in known}

    def term(m: re.Match) -> str:
        w = m[0].lower()
        if w in stems:
            return m[0]
        to = SYNONYMS.get(w)
        return BUSINESS_TERMS.get(w) or (to if to and (to in stems or singular(to) in stems) else m[0])

    return re.sub(r"[A-Za-z]+", term, text)


@dataclass(frozen=True)
class Diagnosis:
    table: str | None
    columns: tuple[str, ...]
    unknown: tuple[str, ...]
    suggestions: tuple[tuple[str, str], ...]


def diagnose(question: str, tables: list[TableInfo]) -> Diagnosis:
    """Table with most columns in the question, those columns, words that mean none, and what they may be."""
    tokens = words_of(question)
    ranked = sorted(((len({c for m in mentions(tokens, t) for c in m.columns}), -i) for i, t in enumerate(tables)), reverse=True)
    if not ranked or not ranked[0][0]:
        return Diagnosis(None, (), tuple(tokens), ())
    t = tables[-ranked[0][1]]
    found = mentions(tokens, t)
    used = {i for m in found for i in range(m.start, m.end)}
    rest = tuple(w for i, w in enumerate(tokens) if i not in used and len(w) > 3 and w.isalpha() and w not in QUESTION_WORDS and not match_column(w, t.columns))
    _, hints = correct_spelling(" ".join(rest), [t])
    return Diagnosis(t.name, tuple(dict.fromkeys(c for m in found for c in m.columns)), rest, tuple(hints))


# Shares of the stages in the confidence of an answer.
CONFIDENCE_WEIGHTS = {"preprocessing_low": 0.12, "classification": 0.18, "schema": 0.22, "intent_extraction": 0.16, "query_execution": 0.16, "visualization": 0.08, "forecasting": 0.08}


def confidence(scores: dict[str, float]) -> float:
    """Weighted mean of stage scores from 0 to 1; a stage without score counts 0."""
    return sum(w * min(1.0, max(0.0, scores.get(k, 0.0))) for k, w in CONFIDENCE_WEIGHTS.items())


def review(question: str, ir: QueryIR) -> list[str]:
    """What a plan lacks of the question: a limit for a top N, a grouping for a per, an ordering for a ranking."""
    text = " ".join(words_of(question))
    out = []
    m = re.search(r"\b(?:top|bottom) (\d+)\b", text)
    if m and ir.limit != int(m[1]):
        out.append(f"asked for {m[1]} rows, limit is {ir.limit}")
    if re.search(r"\b(?:per|for each|in each)\b", text) and not ir.dimensions and not ir.time_granularity and not any(x.ratio for x in ir.metrics):
        out.append("asked for groups, none in the plan")
    if re.search(r"\b(?:highest|lowest|largest|smallest)\b", text) and not ir.order_by:
        out.append("asked for a ranking, no order in the plan")
    return out
