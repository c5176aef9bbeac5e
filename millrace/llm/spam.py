"""Keyword-stuffed and link-list pages.

Two views of the whole text decide:

* Recurrence: the gaps at which terms return. ``near`` is the share of content terms that returned within a lag window,
  ``auto`` the strongest autocorrelation of the sequence of terms over the lags of that window and over the commonest
  gaps beyond it, so that a block of any length that is repeated shows. Prose repeats its terms rarely and at irregular
  gaps, in any language; stuffed pages repeat them at once and in step. Both are measured for every text.
* Lists of distinct nouns: the share of the text in lines or sentences that hold links, tags, separators or short items
  but no function words. A missing function word alone tells nothing, since the language may not be known here; there
  must be the form of a list, or a run of words that lacks short words and the end of a sentence too. Statements of
  query languages, log lines and serialised objects, told by their grammar, are neither prose nor list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of the languages of the texts.
FUNCTION_WORDS = {
    "en": "a an and are as at be because been before but by for from had has have he her his how i if in into is it its just more no nor not of on or our so some than that the their them then there these they this those to until up was we were what when which while who will with without would you your after although since even though only during once nobody near",
    "de": "aber als am an auch auf aus bei beim bis das dass dem den der des die doch durch ein eine einem einen einer eines er erst es für hat haben ich im in ist kein keine keinen mit nach nicht noch nur ob obwohl oder ohne sehr sich sie sind sodass so über um und uns vom von vor war was weil wenn wie wir wird wurde zu zum zur zwischen schon",
    "fr": "au aux avec ce ces cette comme dans de depuis des donc du elle en est et eu il ils je la le les leur lors mais ne ni nous on ou où par parce pas pendant plus pour qu que qui sa sans se ses si son sont sur un une vers vous à a été après avant",
    "es": "a al aunque como con cuando de del desde donde durante el ella en entre era es esta este ha hasta hay la las le lo los más mientras muy ni no nos o para pero por porque que se según ser si sin sobre son su sus también tras un una y ya fue antes después",
}
WORDS = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())

#: Lags of the window, further lags taken from the commonest gaps, least number of terms.
LAG, LONG_LAGS, LEAST_TERMS = 24, 8, 8
_TERM = re.compile(r"[^\W\d_](?:[\w'’]*[^\W_])?")
_LINK = re.compile(r"(?:https?://|www\.)\S+|(?<![\w.-])[\w-]++(?:\.[\w-]++)++/\S*")  # one start per run: linear in very long texts
_SENTENCE = re.compile(r"([.!?])\s+")
_LINE = re.compile(r"[\r\n]+")
#: Log lines, traces, lines of serialised objects; statements of a query language and the clauses that go on with one.
_MACHINE = re.compile(r"""^\s*(?:\d{4}-\d\d-\d\d[ t]\d\d:\d\d|[{}\[\]]+[,;]?\s*$|[{\[].*":|"[^"]*"\s*:|traceback\b|at [\w.$]+\(|```)""")
#: Signs that a text may hold any of these.
_HINT = re.compile(r"\d{4}-\d\d-\d\d[ Tt]\d|[{}\[\]`\"]|^\s*(?:traceback|at |select|with|insert|update|delete|create|alter)\b", re.I | re.M)
_SELECT = re.compile(r"^\s*select\b")
_FROM = re.compile(r"\bfrom\s+[\w.\"`]+")
_STATEMENT = re.compile(r"^\s*(?:with\s+\w+\s+as\s*\(|insert\s+into\s|update\s+\S+\s+set\b|delete\s+from\s|create\s+(?:or\s+replace\s+)?(?:table|view|index)\b|alter\s+table\b)")
_CLAUSE = re.compile(r"^\s*(?:from|where|and|or|group by|order by|(?:left |right |inner |full |cross )?join|on|having|limit|union|values|set|returning)\b|^\s*\)")
_END = re.compile(r"[.!?…:][\"'”»)]*\s*$")
_SEPARATOR = re.compile(r"[|/,;·•»→]|\s[-–:]\s|#\w")
#: A bullet or not, then a keyword or a key with its value.
_ITEM = re.compile(r"^\s*(?:[-*+•–]\s+|\d{1,3}[.)]\s+)?[^\W\d_][\w'’&+. -]{0,60}(?::\s*[^\s(){}\[\]=<>][^(){}\[\]=<>]{0,60})?\s*$")
_DIGITS = re.compile(r"\d+")


def recurrence(terms: list[str], lag: int = LAG) -> tuple[float, float]:
    """(share of terms that returned within ``lag``, strongest autocorrelation over the lags 1..``lag`` and the commonest gaps)."""
    n = len(terms)
    if n < 8:
        return 0.0, 0.0
    codes: dict[str, int] = {}
    x = np.fromiter((codes.setdefault(t, len(codes)) for t in terms), np.int32, n)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    gaps = (order[1:] - order[:-1])[same]
    near = float((gaps <= lag).sum()) / n
    share = np.bincount(x) / n
    chance = float((share**2).sum())
    if chance >= 1:
        return near, 1.0
    far = np.bincount(gaps[(gaps > lag) & (gaps <= n // 8)], minlength=1)  # eight times in step at least
    lags = [int(k) for k in np.argsort(-far, kind="stable")[:LONG_LAGS] if far[k] >= 0.05 * n]
    best = max((float((x[k:] == x[:-k]).mean()) for k in lags), default=0.0)
    window = min(lag, n // 8)
    pairs = np.zeros(window + 1, np.int64)  # equal terms at each distance of the window
    for j in range(1, window + 1):
        apart = (order[j:] - order[:-j])[x[order[j:]] == x[order[:-j]]]
        apart = apart[apart <= window]
        if not len(apart):
            break
        pairs += np.bincount(apart, minlength=window + 1)
    if window:
        best = max(best, float((pairs[1:] / (n - np.arange(1, window + 1))).max()))
    return near, max(0.0, (best - chance) / (1 - chance))


def machine_lines(segments: list[str]) -> list[bool]:
    """Which segments are log lines, parts of statements or serialised objects."""
    out, inside = [], False
    for i, seg in enumerate(segments):
        if _STATEMENT.match(seg) or (_SELECT.match(seg) and (_FROM.search(seg) or (i + 1 < len(segments) and _FROM.match(segments[i + 1].lstrip())))):
            inside = True
        elif inside and not _CLAUSE.match(seg):
            inside = False
        out.append(inside or bool(_MACHINE.match(seg)))
    return out


def features(text: str | None) -> dict[str, float]:
    """Measures of one whole text; all zero for null, empty and very short ones."""
    out = {"terms": 0.0, "near": 0.0, "auto": 0.0, "unique": 1.0, "listed": 0.0, "prose": 0.0, "function": 0.0}
    if not text:
        return out
    segments = _LINE.split(_SENTENCE.sub(r"\1\n", text.lower()))
    terms = [_TERM.findall(x) for x in segments]
    words = [w for t in terms for w in t]
    if not words:
        return out
    known = [sum(map(WORDS.__contains__, t)) for t in terms]
    out["terms"] = float(len(words))
    out["function"] = sum(known) / len(words)
    out["unique"] = len(set(words)) / len(words)
    out["near"], out["auto"] = recurrence([w if w.isalpha() else _DIGITS.sub("0", w) for w in words if w not in WORDS])
    machine = machine_lines(segments) if _HINT.search(text) else [False] * len(segments)
    short = [not m and not fw and len(t) <= 6 and bool(_ITEM.match(x)) for x, t, m, fw in zip(segments, terms, machine, known)]
    items = sum(short) >= 10  # many short lines without function words are a list, a few are headings or fields
    listed = prose = total = 0
    for seg, item, tokens, skip, fw in zip(segments, short, terms, machine, known):
        size = len(seg.strip())
        total += size
        if skip or not size:
            continue
        n = len(tokens)
        is_list = "/" in seg and sum(map(len, _LINK.findall(seg))) > 0.3 * size or (items and item) or not n
        if not is_list and fw <= 0.2 * n:
            cuts, ends = len(_SEPARATOR.findall(seg)), bool(_END.search(seg))
            dense = cuts >= 2 and n <= 3.5 * (cuts + 1) if ends else cuts >= 1 and n <= 6 * (cuts + 1)
            loose = n > 12 and not ends and sum(len(t) <= 3 for t in tokens) < 0.12 * n
            is_list = cuts >= 3 and n <= 3.5 * (cuts + 1) or (fw <= 0.08 * n and (dense or loose))
        if is_list:
            listed += size
        elif fw >= 0.1 * n or n > 4:
            prose += size
    out["listed"], out["prose"] = listed / max(total, 1), prose / max(total, 1)
    return out


def is_spam(f: dict[str, float]) -> bool:
    """By far the most of the text is repeated keywords, links, tags or attributes; texts of under 8 terms repeat nothing.

    Among function words, repetition counts only in step (a few sentences said again are none).
    """
    if f["terms"] < LEAST_TERMS:
        return False
    in_step = f["auto"] >= 0.25 and f["near"] >= 0.4 or f["auto"] >= 0.5
    stuffed = (in_step or (f["near"] + f["auto"] >= 0.6 and f["function"] < 0.35)) and f["unique"] <= 0.35
    listing = f["listed"] >= 0.55 and f["prose"] <= 0.45
    return stuffed or listing


def find_spam(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` of the pages that consist of keywords, links, tags or attributes; no shuffle, whole texts.

    Null, empty and very short texts are honest. Each row is judged alone, so hot sources do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = pa.array([is_spam(features(t)) for t in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(flags)], [id_col])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}")
