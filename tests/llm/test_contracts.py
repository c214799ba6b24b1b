"""Each operator's query against a brute-force version in plain Python, over a small table with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, digest string, src string"

ODD = [
    None,
    "",
    " \t\n ",
    "one two",
    "one two three four",
    "One  Two\nthree four",
    "a",
    "1234 5678",
    "Licensed under the Apache License, Version 2.0. MIT License; mit\x00license GENERAL public LICENSE apache license",
    "mail me: a.b+c@ex-ample.co.uk, x@y.z_q@w.v or +1 (743) 555-3824; 1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.04",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111111111111 +4111111111111111",
    "x" * 5000,
    "Ünïcode ÄÖÜ ß \U0001f600 a@b.cd Éé",
    "tail  \n\n\n  spaces   ",
    "sep\x1carated \x85 next\xa0word   three   spaces  ",
    "<|endoftext|> and <|startoftext|> inside",
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents of the smallest table, odd rows, repeated rows, near copies and clashing extra columns."""
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = docs[:120]
    rng = np.random.default_rng(1)
    rows = list(base)
    at = 10_000
    for i, text in enumerate(ODD):
        rows.append((at + i, text, "en" if i % 3 else None, None if i % 4 == 0 else f"src{i % 5}"))
    for i in range(60):  # near copies of one text and exact copies of another
        words = base[3][1].split(" ")
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = f"edit{rng.integers(1000)}"
        rows.append((20_000 + i, " ".join(words), "en", "src0"))
        rows.append((30_000 + i, base[5][1].replace(" ", "  " if i % 2 else " "), "en", "src0"))
    rows.append((40_000, base[7][1] + " contact kestrelnaut team@corp.example kestrelnaut", "en", "src1"))
    for i in range(1, 6):
        rows.append((40_000 + i, base[8 + i][1] + " contact kestrelnaut team@corp.example now", "en", "src1"))
    path = tmp_path_factory.mktemp("docs")
    frame = spark.createDataFrame([(a, b, c, d, len(b or ""), "k", 1, "d", "s") for a, b, c, d in rows], SCHEMA)
    frame.repartition(5).write.parquet(f"{path}/documents.parquet")
    empty = tmp_path_factory.mktemp("none")
    frame.limit(0).write.parquet(f"{empty}/documents.parquet")
    nulls = tmp_path_factory.mktemp("nulls")
    spark.createDataFrame([(None, "same words in both of these rows", "en", None, None, None, None, None, None)] * 2 + [(None,) * 9] * 2 + [(7, "same words in both of these rows", None, "a", None, None, None, None, None)] * 3, SCHEMA).write.parquet(f"{nulls}/documents.parquet")
    return {"rows": rows, "path": str(path), "empty": str(empty), "nulls": str(nulls)}


def result(spark, table, name, which="path"):
    return [r.asDict() for r in queries.QUERIES[name](spark, table[which]).collect()]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


#: Those that read documents alone; the others have modules of their own.
OF_DOCUMENTS = [name for name in queries.QUERIES if int(name[2:].split("_")[0]) <= 10]


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_table(spark, table, name):
    assert result(spark, table, name, "empty") == []


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_null_ids_and_repeated_rows(spark, table, name):
    assert len(result(spark, table, name, "nulls")) == 7


def test_license_scan(spark, table):
    got = by_id(result(spark, table, "op1_license_scan"))
    assert len(got) == len(table["rows"])
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for doc_id, text, *_ in table["rows"]:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_templates_need_mandatory_words():
    from jobloom.llm.license_scan import Scanner, words_of

    scan = Scanner([("copyright {{2}} all [[of the|the]] rights [[hereby]] reserved", "t")], [])
    hit = lambda s: [m[:3] for m in scan.matches(words_of(s))]
    assert hit("Copyright Me, all rights reserved") == [(0, 5, "t")]
    assert hit("x copyright all of the rights hereby reserved") == [(1, 8, "t")]
    assert hit("copyright a b c all rights reserved") == []
    assert hit("copyright a all of rights reserved") == []


def test_token_store(spark, table, tmp_path):
    from tokenizers import Tokenizer

    from jobloom.llm import token_store

    vocabulary = queries.vocabulary_path(queries.WORD_VOCABULARY)
    library = Tokenizer.from_file(vocabulary)
    got = by_id(result(spark, table, "op2_token_store"))
    start, expected = 0, {}
    for doc_id, text, *_ in sorted(table["rows"]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        expected[doc_id] = ids
        assert got[doc_id] == {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    docs = spark.read.parquet(f"{table['path']}/documents.parquet")
    token_store.write_store(docs, f"{tmp_path}/store", vocabulary)
    assert token_store.read_document(spark, f"{tmp_path}/store", 10_009) == [expected[10_009]]
    assert token_store.read_document(spark, f"{tmp_path}/store", -5) == []


def _pii(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_pii(spark, table):
    got = by_id(result(spark, table, "op3_pii"))
    assert len(got) == len(table["rows"])
    for doc_id, text, *_ in table["rows"]:
        base, r = _pii(text or ""), got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (doc_id, base, r["spans"])
        kinds = Counter(x.split(":")[0] for x in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(filter(None, r["spans"].split(",")))
        if not base:
            assert r["spans"] == ""
    texts = {a: b for a, b, *_ in table["rows"]}
    for i in range(6):
        terms = [x.split(":") for x in got[40_000 + i]["spans"].split(",") if x.startswith("term")]
        assert "kestrelnaut" in {texts[40_000 + i][int(s) : int(e)] for _, s, e in terms}


def test_sanitised_text(spark, table):
    from jobloom.llm import pii

    docs = spark.read.parquet(f"{table['path']}/documents.parquet").filter("doc_id >= 40000 or doc_id < 100")
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "team@corp.example" not in got[40_001] and "<email>" in got[40_001] and "kestrelnaut" not in got[40_001]


def test_terms_count_over_whole_texts(spark):
    """Telling terms far from their entity, and every one of their places, against counts by hand."""
    from math import log2

    from jobloom.llm import pii

    filler = "lorem ipsum dolor sit amet " * 40
    texts = [f"Kestrelnaut {i} {filler} write to ops{i % 2}@corp.example or +41 44 555 12 3{i % 2} {filler} KESTRELNAUT, near{i % 2}x{'ab'[i % 2] * 4} again kestrelnaut" for i in range(6)]
    texts += [f"{filler} mail ops0@corp.example {'osprey ' * (i % 3)}" for i in range(5)] + [f"osprey {filler} {i}" for i in range(2)] + [f"plain {filler} {i}" for i in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = len(texts)
    terms = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for t in texts]
    spans = [_pii(t or "") for t in texts]
    held = [{(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in s} for t, s in zip(texts, spans, strict=True)]
    n_term, n_entity = Counter(w for ws in terms for w in ws), Counter(e for es in held for e in es)
    n_pair = Counter((e, w) for es, ws in zip(held, terms, strict=True) for e in es for w in ws)
    share = {(e, w): log2(n * total / (n_entity[e] * n_term[w])) / log2(total / n_entity[e]) for (e, w), n in n_pair.items() if n >= 3}
    found = pii.mentions(docs).checkpoint()
    assert sorted(r["disclosure"] for r in pii.disclosures(docs, found).collect()) == pytest.approx(sorted(share.values()))
    for r in pii.find_spans(docs).collect():
        text, i = texts[r["doc_id"]] or "", r["doc_id"]
        base = [tuple(map(int, x.split(":")[1:])) for x in spans[i]]
        best = {w: max((share.get((e, w), -9) for e in held[i]), default=-9) for w in terms[i]}
        expected = [(m.start(), m.end(), best[m[0].lower()] >= 0.8) for m in re.finditer(r"[^\W\d_]{3,}", text) if best[m[0].lower()] >= 0.6 and not any(s < m.end() and e > m.start() for s, e in base)]
        assert [tuple(t) for t in r["terms"]] == expected
        assert i >= 6 or "kestrelnaut" not in pii_text(expected, text)
    assert all("kestrelnaut" not in (r["text"] or "").lower() for r in pii.sanitised(docs).collect())


def pii_text(spans, text):
    """The text in small letters without spans."""
    for s, e, _ in reversed(spans):
        text = text[:s] + text[e:]
    return text.lower()


def test_water_filling(spark, table):
    got = by_id(result(spark, table, "op4_water_filling"))
    assert got == by_id(result(spark, table, "op4_water_filling"))
    size = {a: len(re.findall("[^\x20\x09-\x0d]+", b or "")) for a, b, *_ in table["rows"]}
    own = defaultdict(int)
    for a, _, _, s in table["rows"]:
        own[s] += size[a]
    order = sorted(own, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(own.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= over
    taken = defaultdict(int)
    most = defaultdict(int)
    for a, _, _, s in table["rows"]:
        r = got[a]
        assert (r["size"], r["source_size"]) == (size[a], own[s]) and r["target"] == pytest.approx(target[s], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], size[a])
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s]


def test_water_filling_cuts_rows_without_ids_like_others(spark):
    """400 rows, every second id null and all their texts equal: taken words come within a document of each target."""
    from jobloom.llm import mixing

    rows = [(None if i % 2 else i, "five words in every text" if i % 2 else f"four words in {i}", ("a", "b", "c")[min(i % 7, 2)], i, i, "x", "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key_0 long, cut_0 long, copy_0 string, _cut string").repartition(6)
    plan = mixing.mix_plan(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(plan) == 3 and all(abs(r["taken"] - r["target"]) <= 5 for r in plan), plan
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    sizes = got.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == sorted(r["taken"] for r in plan)


def test_helpers_own_names_are_passed_on(spark):
    """Extra columns with the names of helper columns, repeated rows and null ids, through the stages that keep columns."""
    from jobloom.llm import exact_dedup, jaccard_join

    names = ["_digest", "_first", "_kept_id", "mark_0", "stay_0", "row_0", "slot_0", "piece_0", "bits_0", "gone_0", "m", "i", "d", "id", "key"]
    texts = ["one two three four five six", "one two  three four five six", "other words here that stay alone", None, "", "one two three four five six"]
    rows = [(i if i != 5 else 0, t, *("v" for _ in names)) for i, t in enumerate(texts)] + [(None, "other words here that stay alone", *("v" for _ in names))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, texts[1]), (2, texts[2]), (3, None)]
    once = jaccard_join.one_of_each(docs)
    assert once.columns == docs.columns
    assert {r["doc_id"] for r in once.collect()} == {0, 2, 3, 4, None}


def test_jaccard_join_holds_words_against_each_other(spark, monkeypatch):
    """Words whose polynomial hashes collide for any odd base, and links when every hash is the same."""
    from jobloom.llm import jaccard_join

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}
    import pyarrow as pa

    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k l m", "n o p q r s t u v w x y"]
    monkeypatch.setattr(jaccard_join, "_mixed", lambda x: x & np.uint64(0))
    words = jaccard_join.words_of(pa.array(texts))
    joint = jaccard_join._shingles(words)
    listed = [jaccard_join._listed(words, i, joint) for i in range(3)]
    linked = lambda i, j: jaccard_join._linked(words, i, listed[i], words, j, listed[j], 80)
    assert linked(0, 1) and not linked(0, 2) and not linked(1, 2)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    import pyarrow as pa

    from jobloom.llm import jaccard_join

    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{rng.integers(50)}" * int(rng.integers(1, 9)) for _ in range(n)) for n in (0, 3, 400, 5, 900)] + ["", " \n"]
    whole = jaccard_join.shingle_sets(pa.array(texts))
    assert [len(s) for s in whole] == [len(s) for s, _ in [_set_of(t) for t in texts]]
    monkeypatch.setattr(jaccard_join, "BLOCK", 11)
    assert all(np.array_equal(a, b) for a, b in zip(whole, jaccard_join.shingle_sets(pa.array(texts)), strict=True))


def _set_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set(), words


def test_mixed_rows_repeat(spark, table):
    from jobloom.llm import mixing

    docs = spark.read.parquet(f"{table['path']}/documents.parquet")
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    times = Counter(r["doc_id"] for r in rows.select("doc_id").collect())
    assert times == Counter({r["doc_id"]: r["times"] for r in result(spark, table, "op4_water_filling") if r["times"]})


def test_ids_do_not_depend_on_what_is_kept():
    from jobloom.llm.queries import BYTE_VOCABULARY, vocabulary_path
    from jobloom.llm.tokens import ByteEncoder

    path = vocabulary_path(BYTE_VOCABULARY)
    small, large = ByteEncoder(path, 2), ByteEncoder(path)
    text = "One two, three.\nFour five\nsix  seven äöü 12 one two. " * 3 + "end"
    whole = np.array(large.first.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert small(text) == large(text) == whole
    assert max(map(len, (small.first, small.first.before, small.later, small.later.before))) <= 2


def test_packing(spark, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path(queries.BYTE_VOCABULARY))
    got = defaultdict(list)
    for r in result(spark, table, "op5_best_fit_packing"):
        got[r["doc_id"]].append(r)
    sequences = defaultdict(list)
    for doc_id, text, *_ in table["rows"]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(got[doc_id], key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(own):
            assert (r["piece"], r["start"]) == (i, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or i == 0 and r["length"] <= 1024
            at += r["length"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert at == len(ids)
    total = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(sequences) <= -(-total // 1024) * 1.03 + 1


def _falling_one_by_one(items, capacity):
    """Best-fit in falling order, item by item."""
    bins = []
    for x in sorted(items, reverse=True):
        fits = [i for i, b in enumerate(bins) if capacity - b >= x]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += x
        else:
            bins.append(x)
    return len(bins)


def _fewest(items, capacity):
    """The fewest bins, by trying all."""
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                put(i + 1, bins)
                bins[j] -= items[i]
        bins.append(items[i])
        put(i + 1, bins)
        bins.pop()

    items = sorted(items, reverse=True)
    put(0, [])
    return best[0]


def test_reduction_loses_nothing():
    from jobloom.llm.packing import best_fit_falling, pack_counts, reduce_by_dominance

    rng = np.random.default_rng(4)
    for _ in range(300):
        items = rng.integers(1 if rng.random() < 0.5 else 5, 21, int(rng.integers(1, 10))).tolist()
        fixed, remain = reduce_by_dominance(dict(Counter(items)), 20)
        rest = [x for x, n in remain.items() for _ in range(n)]
        assert sum(fixed.values()) + (_fewest(rest, 20) if rest else 0) == _fewest(items, 20), items
        packed = Counter()
        for pattern, n in pack_counts(dict(Counter(items)), 20):
            assert sum(a * b for a, b in pattern) <= 20
            for length, each in pattern:
                packed[length] += n * each
        assert packed == Counter(items)
        assert sum(best_fit_falling(dict(Counter(items)), 20).values()) == _falling_one_by_one(items, 20)


def test_language_id(spark, table):
    rows = result(spark, table, "op6_language_id")
    lang = {a: c for a, _, c, _ in table["rows"]}
    text = {a: b for a, b, *_ in table["rows"]}
    right = seen = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        if r["held_out"] and r["doc_id"] < 10_000:
            seen += 1
            right += r["lang_pred"] == lang[r["doc_id"]]
    assert right >= 0.85 * seen


def test_exact_dedup(spark, table):
    got = by_id(result(spark, table, "op7_exact_dedup"))
    groups = defaultdict(list)
    for a, b, *_ in table["rows"]:
        groups[re.sub("[\x20\x09-\x0d]", "", b or "")].append((-len(b or ""), a))
    for key, own in groups.items():
        for _, a in own:
            assert got[a] == {"doc_id": a, "keep_id": min(own)[1], "group_size": len(own), "kept": a == min(own)[1], "text_sha256": hashlib.sha256(key.encode()).hexdigest()}


def test_exact_dedup_heavy_groups_are_the_same(spark, table):
    from jobloom.llm import exact_dedup

    docs = spark.read.parquet(f"{table['path']}/documents.parquet")
    assert {tuple(r) for r in exact_dedup.duplicate_groups(docs, counters=4).collect()} == {tuple(r) for r in exact_dedup.duplicate_groups(docs).collect()}
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == exact_dedup.duplicate_groups(docs).filter("kept").count()


def test_exact_dedup_keeps_one_of_repeated_rows(spark, table):
    from jobloom.llm import exact_dedup

    rows = result(spark, table, "op7_exact_dedup", "nulls")
    assert sum(r["kept"] for r in rows) == 2 and {r["keep_id"] for r in rows} == {7, None}
    assert exact_dedup.without_duplicates(spark.read.parquet(f"{table['nulls']}/documents.parquet")).count() == 2


def test_mpeg_audio(spark, table):
    for doc_id, r in by_id(result(spark, table, "op8_mpeg_audio")).items():
        raw = next(b or "" for a, b, *_ in table["rows"] if a == doc_id).encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["seconds"] == len(payload) // 576 * 576 / 16000
        assert f"frames={len(payload) // 576};" in r["feature"]


def test_audio_resynchronises():
    from jobloom.llm.media_audio import parse_stream, read_payload, store_payload

    payload = bytes(range(256)) * 9
    media = store_payload(payload)
    clean = parse_stream(media)
    assert clean.declared_frames == len(clean.offsets) == 4 and clean.broken == 0 and clean.title == "payload of 2304 bytes"
    cut = clean.offsets[1]
    damaged = parse_stream(media[:cut] + b"\xff\xf2junk\xff" + media[cut:])
    assert damaged.skipped == 7 and len(damaged.offsets) == 4
    assert read_payload(media[:cut] + b"\xff\xf2junk\xff" + media[cut:], damaged) == payload
    wrong = bytearray(media)
    wrong[clean.offsets[2] + 8] ^= 1
    assert parse_stream(bytes(wrong)).broken == 1
    assert clean.seek(0.0) == clean.offsets[0] and clean.seek(0.04) == clean.offsets[1] and clean.seek(9.0) is None
    assert parse_stream(b"").seconds == 0 and parse_stream(b"\xff" * 5000).offsets == []


def test_sharding(spark, table):
    rows = result(spark, table, "op9_stratified_shards")
    text = {a: b or "" for a, b, *_ in table["rows"]}
    source = {a: s for a, _, _, s in table["rows"]}
    shards = defaultdict(list)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r["shard"]].append(r)
    counts = [len(shards[i]) for i in range(8)]
    assert sum(counts) == len(table["rows"]) and max(counts) - min(counts) <= 1
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sources = Counter(source.values())
    for s, n in sources.items():
        near = 2 + len(sources) * n / len(source)  # one row at each cut, and what rounding in all sources moves the cuts
        assert all(abs(sum(source[r["doc_id"]] == s for r in own) - n / 8) <= near for own in shards.values())


def _components(rows):
    sets, parent = {}, {}
    for a, b, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in b or ""))
        sets[a] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        parent[a] = a

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {a: (len(sets[a]), root(a)) for a in ids}


def test_jaccard_join(spark, table):
    got = by_id(result(spark, table, "op10_jaccard_join"))
    assert {a: (r["n_shingles"], r["component_id"]) for a, r in got.items()} == _components(table["rows"])


def test_jaccard_join_hot_group_and_low_threshold(spark, monkeypatch):
    from jobloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CLASSES", (3, 9, 27))
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base) if i != 71 else base[:]
        for _ in range(int(rng.integers(0, 5)) if i != 71 else 0):
            words[int(rng.integers(80))] = f"e{rng.integers(10_000)}"
        if i % 3 == 0:
            words = [f"u{rng.integers(10_000)}" for _ in range(30)] + words[:50]
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == _components(rows)


def test_jaccard_join_families_near_the_threshold(spark, monkeypatch):
    """Edits around the threshold make families of which one star leaves many pairs to the exact rest."""
    from jobloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CLASSES", (3, 9, 27))
    rng = np.random.default_rng(4)
    rows = []
    for family, size in enumerate((60, 150, 400, 900)):
        base = [f"w{family}x{i}" for i in range(size)]
        for _ in range(30):
            words = list(base)
            for _ in range(max(1, size // int(rng.integers(70, 110)))):
                at = int(rng.integers(size))
                words[at : at + int(rng.integers(2))] = [f"e{rng.integers(10**6)}"]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    rows = [(int(i), text) for i, text in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    wanted = _components(rows)
    assert 4 < len({c for _, c in wanted.values()}) < 110
    assert got == wanted


def test_language_stage_keeps_documents_without_labels(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "ß", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {1, 4}


def test_pipeline(spark, table):
    import corpus_pipeline

    docs = spark.read.parquet(f"{table['path']}/documents.parquet")
    lettered = [r for r in table["rows"] if any(c.isalpha() for c in r[1] or "")]
    first = corpus_pipeline.language(spark, docs, table["path"])
    assert first.columns == docs.columns and {r["doc_id"] for r in first.select("doc_id").collect()} == {r[0] for r in lettered}
    groups = {}
    for r in sorted(lettered, key=lambda r: (-len(r[1]), r[0])):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1]), r)
    second = corpus_pipeline.exact_duplicates(spark, first, table["path"])
    assert {r["doc_id"] for r in second.select("doc_id").collect()} == {r[0] for r in groups.values()}
    third = corpus_pipeline.near_duplicates(spark, second, table["path"])
    kept = {a for a, (_, c) in _components(groups.values()).items() if a == c}
    assert third.columns == docs.columns and {r["doc_id"] for r in third.select("doc_id").collect()} == kept
    packed = corpus_pipeline.run(spark, table["path"])
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= kept
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def _mixed_times(rows):
    """How often each of (id, text, lang, source) comes, by the rule of the mix; ids are unique."""
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    key = {r[0]: int(hashlib.md5(f"29:{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for r in rows}
    ids = defaultdict(list)
    for r in rows:
        ids[r[3]].append(r[0])
    own = {s: sum(size[a] for a in of) for s, of in ids.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(own), float(sum(own.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]} or free
        for s in over:
            target[s] = min(share[s], 3.0 * own[s])
            left -= target[s]
        free = free - over
    times = Counter()
    for s, of in ids.items():
        whole, before = (int(target[s] // own[s]) if own[s] else 0), 0
        for a in sorted(of, key=key.get):
            before += size[a]
            more = before - size[a] / 2 <= target[s] - whole * own[s]
            times[a] = (whole + more) if size[a] else 0
    return +times


def test_pipeline_run_mixes_and_packs_everything(spark, table):
    """Pieces of run() against a brute-force mix of what the third stage keeps, tokenised by the library."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    library = Tokenizer.from_file(queries.vocabulary_path(queries.BYTE_VOCABULARY))
    groups = {}
    for r in sorted((r for r in table["rows"] if any(c.isalpha() for c in r[1] or "")), key=lambda r: (-len(r[1]), r[0])):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1]), r)
    alone = {a for a, (_, c) in _components(groups.values()).items() if a == c}
    kept = [r for r in groups.values() if r[0] in alone]
    times, expected, sequences, got = _mixed_times(kept), Counter(), defaultdict(list), Counter()
    for doc_id, text, *_ in kept:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at, to = 0, (len(ids) - 1) % 1024 + 1
        for piece in range(-(-len(ids) // 1024)):
            expected[(doc_id, piece, at, to - at, zlib.crc32(ids[at:to].tobytes()))] = times[doc_id]
            at, to = to, to + 1024
    for r in corpus_pipeline.run(spark, table["path"]).collect():
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == +expected
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
