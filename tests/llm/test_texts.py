"""Text operators against brute force, round trips and made-up pages."""

import datetime as dt
import random

import pytest

from millrace.llm import bpe, neardup, packing, spam

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def spark():
    from millrace.session import local_session

    s = local_session(cores=4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(bpe.default_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- encoding ------------------------------------------------------------------------------------------------


def test_merges_equal_naive_ones(reference):
    ranks = bpe.load_ranks(bpe.default_path())

    def naive(piece: bytes):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(ranks[p] for p in parts)

    rng = random.Random(1)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aabbcetsh \xc3\xa9\xff0") for _ in range(rng.randint(1, 24)))
        assert bpe.merge(piece, ranks) == naive(piece)


def test_texts_equal_the_public_library(reference):
    enc = bpe.encoder()
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "​", "　", "a", "Word", "é", "1", "٣", "!", '"', "'s", "'LL", "中文", "😀", "́", "_", "\r\n", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))
        ids = enc.encode(text)
        assert ids == reference.encode_ordinary(text) and enc.count(text) == len(ids)
        assert reference.decode(ids) == text
    for text in ("ab" * 40_000, "x" * 50_000, " " * 30_000, "é" * 20_000 + " z"):
        assert enc.encode(text) == reference.encode_ordinary(text)


def test_bounded_tables(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    enc = bpe.Encoder(bpe.default_path(), bpe.default_pattern())
    text = "one two three four five six seven one two " * 3
    assert enc.encode(text) == reference.encode_ordinary(text) and len(enc.pieces) <= 3 and len(enc.words) <= 3


def test_encode_frame(spark, reference):
    texts = ["Hello world", "", None, "a", "a"]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, n_tokens string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------------


def test_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(300):
        have = {}
        for _ in range(rng.randint(1, 7)):
            k = rng.randint(1, 30)
            have[k] = have.get(k, 0) + 1
        cap = rng.randint(max(have), 60)
        used = packing.fill(dict(have), cap)
        assert used[max(have)] >= 1 and all(have[k] >= n for k, n in used.items())
        rest = [k for k, n in have.items() for _ in range(n)]
        rest.remove(max(have))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        best = max(s for s in sums if s + max(have) <= cap)
        assert sum(k * n for k, n in used.items()) == best + max(have)


def _first_fit(sizes, cap):
    free = []
    for n in sorted(sizes, reverse=True):
        for i, room in enumerate(free):
            if n <= room:
                free[i] -= n
                break
        else:
            free.append(cap - n)
    return len(free)


def test_plan_uses_every_item_once():
    rng = random.Random(4)
    hist = {rng.randint(1, 200): rng.randint(1, 500) for _ in range(80)}
    steps = packing.plan(hist, 200)
    used = {}
    for contents, times in steps:
        assert sum(k * n for k, n in contents.items()) <= 200
        for k, n in contents.items():
            used[k] = used.get(k, 0) + n * times
    assert used == hist
    assert sum(t for _, t in steps) <= _first_fit([k for k, n in hist.items() for _ in range(n)], 200)


def _check(rows, items, cap):
    size, parts = {}, {}
    for r in rows:
        size[r["container_id"]] = size.get(r["container_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["token_start"], r["n_tokens"]))
    assert max(size.values()) <= cap and sorted(size) == list(range(len(size)))
    for d, n in items.items():
        p = sorted(parts.pop(d, []))
        assert sum(x[2] for x in p) == n and len(p) == -(-n // cap)
        assert [x[1] for x in p] == [cap * i for i in range(len(p))]
    assert not parts
    return len(size)


@pytest.mark.parametrize("group", [10**9, 7])
def test_pack_frame(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    rng = random.Random(5)
    items = {i: 40 if rng.random() < 0.4 else rng.randint(1, 350) for i in range(600)}
    df = spark.createDataFrame([(i, n, 1) for i, n in items.items()] + [(9001, 0, 1), (9002, None, 1)], "doc_id bigint, n_tokens int, rank int")
    n = _check(packing.pack(df, 100).collect(), items, 100)
    assert n <= _first_fit([x for v in items.values() for x in [100] * (v // 100) + [v % 100] * (v % 100 > 0)], 100)


def test_pack_odd_tables(spark):
    df = spark.createDataFrame([(1, 100), (2, 100), (3, 201)], "doc_id bigint, n_tokens int")
    assert _check(packing.pack(df, 100).collect(), {1: 100, 2: 100, 3: 201}, 100) == 5
    assert packing.pack(df.limit(0), 100).count() == 0
    assert packing.pack_texts(spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "doc_id bigint, text string"), 10).count() == 1
    with pytest.raises(ValueError):
        packing.pack(df, 0)


# ---- spam ------------------------------------------------------------------------------------------------------------

PROSE = "The nightly load was stopped because the source sent a new column, and the team restarted it after the check. "
SPAM = [
    "cheap shoes / best shoes / CHEAP SHOES / shoes online / cheap shoes / best shoes / " * 8,
    "Buy red lamp online. Cheap red lamp, red lamp today. Looking for red lamp? red lamp here. red lamp near you! " * 5,
    "\n".join(f"#{w}{i} #{w}deal #{w}" for i, w in enumerate("lamp chair table sofa bed desk shelf rug".split())),
    "\n".join(f"Lamp{i} Pro {i}-pack | red | S | SKU {1000 + i} | {i}.50 | chairs" for i in range(15)),
    "\n".join(f"chairs {w} : www.{w}.test/{w}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()),
    "\n".join(f"* [{w}](https://{w}.example/{w}/x)" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()),
]
HONEST = [
    PROSE * 3, PROSE + "See https://a.example/x and https://b.example/y for the details of the run.", "short", "", None, "lamp " * 3,
    "\n".join("- " + s for s in (PROSE, "The board was yellow until Monday because of the retry queue.", "On Friday the team will look at the totals again.")),
    PROSE + "\n2025-01-26 09:25:31,322 WARN [extractor] rows=9435 batch=7b3c\n2025-01-26 09:25:32,322 INFO [extractor] rows=1 batch=7b3c\n" + PROSE,
    PROSE + "\nSELECT region, sum(total) FROM sales GROUP BY region\n" + '{"source": "crm", "rows": 5, "ok": true}\n' + PROSE,
    "Die nächtliche Ladung wurde angehalten, weil die Quelle eine neue Spalte geschickt hat und das Team sie nicht kannte. Wir haben sie nach der Prüfung wieder gestartet.",
]


def test_spam_pages():
    assert [spam.is_spam(spam.features(t)) for t in SPAM] == [True] * len(SPAM)
    assert [spam.is_spam(spam.features(PROSE + "\n" + t)) for t in SPAM] == [True] * len(SPAM), "a sentence around it does not save it"
    assert [spam.is_spam(spam.features(t)) for t in HONEST] == [False] * len(HONEST)


def test_lists_of_one_item_a_line():
    colours, things = "red green blue black white grey brown pink".split(), "shoes lamps chairs tables sofas beds desks shelves rugs".split()
    pairs = [f"{c} {t}" for c in colours for t in things]
    for form in ("{}", "- {}", "* {}", "color: {}"):
        assert spam.is_spam(spam.features("\n".join(form.format(x) for x in pairs[:40]))), form
        assert spam.is_spam(spam.features(PROSE + "\n" + "\n".join(form.format(x) for x in pairs))), form
    assert not spam.is_spam(spam.features(PROSE * 4 + "\n" + "\n".join(f"- {x}" for x in pairs[:12])))


FOREIGN = [
    "Nocne ładowanie zostało zatrzymane, ponieważ źródło przysłało nową kolumnę. Zespół sprawdził tabelę, poprawił regułę i uruchomił zadanie ponownie. Wyniki wyglądają teraz poprawnie, a raport dla działu sprzedaży został wysłany w poniedziałek rano.",
    "De nachtelijke lading werd gestopt omdat de bron een nieuwe kolom had gestuurd. Het team heeft de tabel bekeken, de regel aangepast en de taak opnieuw gestart. De cijfers kloppen nu weer en het rapport voor verkoop ging maandag de deur uit.",
    "Gece yüklemesi durduruldu, çünkü kaynak yeni bir sütun göndermişti. Ekip tabloyu inceledi, kuralı düzeltti ve görevi yeniden başlattı. Sonuçlar şimdi doğru görünüyor ve satış bölümünün raporu pazartesi sabahı gönderildi.",
    "Ночная загрузка была остановлена, потому что источник прислал новый столбец. Команда проверила таблицу, исправила правило и снова запустила задание. Теперь итоги сходятся, а отчёт для отдела продаж отправлен в понедельник утром.",
]


def test_languages_without_a_word_list():
    assert [spam.is_spam(spam.features(t)) for t in FOREIGN] == [False] * len(FOREIGN)
    assert all(spam.is_spam(spam.features((t.split(". ")[0] + " ") * 12)) for t in FOREIGN), "a phrase repeated in step"


def test_repetition_in_step_decides_whatever_the_words():
    rng = random.Random(12)
    towns = ["Rome", "Bern", "Oslo", "Kyiv"]
    text = " ".join(f"the cheap shoes and the cheap boots and the cheap hats for sale in the city of {rng.choice(towns)}" for _ in range(13))
    assert spam.is_spam(spam.features(text))
    cycle = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    f = spam.features((cycle + " and the end. ") * 9)
    assert f["near"] < 0.05 and f["auto"] > 0.9 and spam.is_spam(f) and not spam.is_spam(f | {"auto": 0.0}), "only the autocorrelation tells"


def test_lists_behind_words_of_statements():
    table = "\n".join(["sofa | lamp | chair | table"] * 10)
    for text in (table, table.replace("sofa", "with sofa"), table.replace("sofa", "From: sofa"), "\n".join("{" + x + "}" for x in table.split("\n"))):
        assert spam.is_spam(spam.features(text))
    query = "SELECT region, city, sum(total), avg(age)\nFROM sales, stores, days\nWHERE region, city IN (a, b, c, d)\nGROUP BY region, city"
    log = "2025-01-26 09:25:31,322 WARN [extractor] rows=9435, batch=7b3c, a, b, c, d, e"
    assert not spam.is_spam(spam.features(PROSE + query)) and not spam.is_spam(spam.features("\n".join([log, PROSE, query, log, '{"a": 1, "b": 2, "c": 3}'])))


def test_long_odd_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("a.a" * 100_000, "a-" * 200_000, "a_'" * 100_000, ", " * 200_000, "\n" * 300_000, "x" * 500_000):
        spam.is_spam(spam.features(t))
    assert time.time() - began < 20


def test_recurrence_against_brute_force():
    rng = random.Random(6)
    for _ in range(50):
        terms = [rng.choice("abcdefghij") for _ in range(rng.randint(8, 60))]
        near, auto = spam.recurrence(terms, 5)
        back = sum(any(terms[j] == terms[i] for j in range(max(0, i - 5), i)) for i in range(len(terms)))
        assert near == pytest.approx(back / len(terms)) and 0 <= auto <= 1


def _long_prose() -> str:
    """Sentences that are all different, of a vocabulary of their own."""
    rng = random.Random(13)
    nouns = ["".join(rng.choice("aeiourstlnm") for _ in range(6)) for _ in range(800)]
    return " ".join(f"After the {rng.choice(nouns)} of the {rng.choice(nouns)} we had to {rng.choice(nouns)} it with a {rng.choice(nouns)}, but not {rng.choice(nouns)}." for _ in range(4000))


def test_spam_frame_and_long_texts(spark):
    rows = [(i, t, "x") for i, t in enumerate(SPAM + HONEST)] + [(100, _long_prose(), "x"), (101, SPAM[0] * 500, "x"), (102, PROSE * 3000, "x")]
    got = {r["doc_id"] for r in spam.find_spam(spark.createDataFrame(rows, "doc_id bigint, text string, near string")).collect()}
    assert got == set(range(len(SPAM))) | {101, 102}, "a sentence repeated in step is no prose"


# ---- near-duplicates ----------------------------------------------------------------------------------------------------


def test_shared_words_against_brute_force():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(7)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = [w for w in a if rng.random() < 0.9] + [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        want = lcs(a, b) / max(len(a), len(b), 1) if a or b else 1.0
        got = neardup.shared_words(a, b)
        assert got == pytest.approx(want) or (got < neardup.MIN_SHARED and want < neardup.MIN_SHARED)


def test_words_ignore_case_spacing_punctuation_and_hidden_signs():
    assert neardup.words("Hello,  WORLD!\n(a­b zero​width)") == ["hello", "world", "ab", "zerowidth"] and neardup.words(None) == []


def _corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    docs, accepted = [], set()
    base = [[rng.choice(vocab) for _ in range(rng.choice([24, 60, 200]))] for _ in range(60)]

    def add(words, batch, ok=True, text=None):
        i = len(docs)
        docs.append((i, batch, f"Row-{i}", text if text is not None else " ".join(words), words))
        if ok:
            accepted.add(f"row-{i}")
        return i

    for k, w in enumerate(base):
        add(w, k % 3, ok=k % 7 != 0)
    for k in range(0, 60, 2):
        w = list(base[k])
        for _ in range(len(w) // 9):
            w[rng.randrange(len(w))] = "changed"
        add(w, 3)
    for k in range(1, 60, 4):
        add(base[k], 4, text=", ".join(base[k]).upper() + "!!")
    for k in range(2, 60, 5):
        add(base[k][: len(base[k]) // 2] + [rng.choice(vocab) for _ in range(len(base[k]) // 2)], 5)
    add(["short"] * 3, 0)
    add(["short"] * 3, 1)
    docs += [(9000, 2, "row-9000", None, []), (9001, None, None, "", [])]
    return docs, accepted


def _frames(spark, docs, accepted):
    d = spark.createDataFrame([(i, b, r, t, "x", 1) for i, b, r, t, _ in docs], "doc_id bigint, batch_no bigint, _row_id string, text string, rep string, key int")
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("k", "b", "load", t, r) for r in sorted(accepted)] + [("k", "b", "extract", t, "row-0"), (None, None, None, None, None)], "_dedup_key string, _batch_id string, _stage string, _processed_at timestamp, _row_id string")
    return d, log


def _want(docs, accepted):
    out = set()
    for i, b, r, _, w in docs:
        for j, c, _, _, v in docs:
            if b is not None and c is not None and b < c and r.lower() in accepted and len(w) >= neardup.MIN_WORDS and len(v) >= neardup.MIN_WORDS and neardup.shared_words(w, v) >= neardup.MIN_SHARED:
                out.add((min(i, j), max(i, j)))
    return out


def _load(spark, path, docs, log):
    return neardup.HistoryIndex(spark, f"{path}/index").load(docs, log, 0)


def test_at_once_and_batch_by_batch_against_brute_force(spark, tmp_path):
    docs, accepted = _corpus()
    d, log = _frames(spark, docs, accepted)
    want = _want(docs, accepted)
    assert len(want) > 30
    got = {tuple(r) for r in _load(spark, tmp_path / "at-once", d, log).collect()}
    assert got == want
    index, found = neardup.HistoryIndex(spark, str(tmp_path / "index"), bucket_keys=1000), set()
    for b, part in enumerate(("batch_no < 3", "batch_no = 3", "batch_no > 3")):
        batch = d.where(part)
        if b == 1:
            index.load(batch, log, b, d).collect()  # loaded again below: replaces itself
            index = neardup.HistoryIndex(spark, str(tmp_path / "index"))
        found |= {tuple(r) for r in index.load(batch, log, b, d).collect()}
    assert found == want


def test_hot_keys_and_batches_of_many_keys(spark, tmp_path, monkeypatch):
    docs, accepted = _corpus()
    d, log = _frames(spark, docs, accepted)
    monkeypatch.setattr(neardup, "HOT_KEY", 1)
    monkeypatch.setattr(neardup, "NAMED", 2)
    index = neardup.HistoryIndex(spark, str(tmp_path / "index"))
    found = {tuple(r) for b in ("batch_no <= 2", "batch_no > 2") for r in index.load(d.where(b), log, int(b[-3] == ">"), d).collect()}
    assert found == _want(docs, accepted)


def test_load_of_odd_tables(spark, tmp_path):
    docs, accepted = _corpus()
    d, log = _frames(spark, docs, accepted)
    assert _load(spark, tmp_path / "a", d.limit(0), log).count() == 0 and _load(spark, tmp_path / "b", d, log.limit(0)).count() == 0
    same = [(i, i % 4, f"r{i}", " ".join(f"x{k}" for k in range(30)), []) for i in range(40)]
    d, log = _frames(spark, same, {f"r{i}" for i in range(40)})
    assert _load(spark, tmp_path / "c", d, log).count() == sum(a[1] != b[1] for a in same for b in same) // 2


def test_recall_with_an_eighth_of_the_words_changed():
    rng = random.Random(10)
    for n in (24, 40, 100, 200):
        met = 0
        for _ in range(300):
            w = [f"w{rng.randrange(4000)}" for _ in range(n)]
            v = [f"x{i}" if i % 8 == 4 else x for i, x in enumerate(w)]
            (k, m), (s, t) = neardup.signatures([w, v])
            agree = sum(32 - ((x := int(p) ^ int(q)) | x >> 1 & (1 << 63) - 1) .__and__(0x5555555555555555).bit_count() for p, q in zip(s.view("u8"), t.view("u8")))
            met += bool((k == m).any()) and agree >= neardup._NEED
        assert met >= 0.985 * 300


def test_load_with_an_eighth_of_the_words_changed(spark, tmp_path):
    rng = random.Random(11)
    docs, want = [], set()
    for k in range(200):
        w = [f"w{rng.randrange(4000)}" for _ in range((24, 40, 100, 200)[k % 4])]
        v = [f"x{i}" if i % 8 == 4 else x for i, x in enumerate(w)]
        docs += [(2 * k, 0, f"r{2 * k}", " ".join(w), []), (2 * k + 1, 1, f"r{2 * k + 1}", " ".join(v), [])]
        want.add((2 * k, 2 * k + 1))
    d, log = _frames(spark, docs, {r[2] for r in docs})
    got = {tuple(r) for r in _load(spark, tmp_path, d, log).collect()}
    assert got <= want and len(got) >= 0.985 * len(want)

