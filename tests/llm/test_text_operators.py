"""The text operators on awkward rows, against plain versions of themselves."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescope.llm import fingerprints, jaccard, language, mixing, packing, quality, secrets, toxicity

from .conftest import ROWS, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# 1 mixing ------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in rest}}
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [3, 128])
def test_mix_meets_targets(awkward, block):
    rows = mixing.mix(awkward, block).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, len(words(t))) for i, t, _, _ in ROWS)
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    goals = plain_targets(sizes)
    by_size = {sizes[s]: goals[s] for s in sizes}
    taken = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(by_size[r["source_size"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for size, goal in by_size.items():
        assert abs(taken[size] - goal) <= 1
    again = mixing.mix(awkward.repartition(3), block).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents_hold_the_words_taken(awkward):
    mixed = mixing.mixed_documents(awkward, 8)
    assert mixed.columns == awkward.columns
    got, sizes = collections.Counter(), collections.Counter()
    texts = {(i, s): t for i, t, _, s in ROWS}
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    for r in mixed.collect():
        got[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        if len(words(r["text"])) == len(words(texts[r["doc_id"], r["source"]])):
            assert r["text"] == texts[r["doc_id"], r["source"]]
    for source, goal in plain_targets(sizes).items():
        assert abs(got[source] - goal) <= 1


def test_rows_alike_under_two_sources_are_mixed_apart(spark, nothing):
    text = sentence(4, 70)
    rows = [(k % 10, text, "ab"[k % 2]) for k in range(60)] + [(None, text, "a")] * 3 + [(7, sentence(k, 40), "b") for k in range(5)]
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), 16).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
    for source, goal in plain_targets(sizes).items():
        assert abs(taken[source] - goal) <= 1
    assert mixing.mixed_documents(nothing).count() == 0


def test_one_row_of_each_component_stays(spark, awkward, nothing):
    text, other = sentence(4, 70), sentence(5, 70)
    rows = [(1, text, "a")] * 3 + [(None, text, "b"), (7, text + " x", "a"), (7, other, "clean"), (9, None, "empty"), (9, None, "empty"), (8, "", "empty")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, bucket string")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["bucket"]) for r in got if r["text"]) == [("1", text, "a"), ("7", other, "clean")]
    assert sorted((r["doc_id"], r["text"] or "") for r in got if not r["text"]) == [(8, ""), (9, ""), (9, "")]
    assert jaccard.one_of_each(nothing).count() == 0
    left = jaccard.one_of_each(awkward)
    assert left.columns == awkward.columns and left.count() == len({t for _, t, _, _ in ROWS if words(t)}) - 1 + sum(not words(t) for _, t, _, _ in ROWS)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 257])
def test_permutation_is_one(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def test_shards_hold_all_slots(spark, awkward):
    sources = mixing.with_slots(mixing.source_targets(mixing.sizes_of(awkward)), 16)
    slots = mixing.mix_slots(sources, 16, shard_slots=32).cache()
    total = sources.agg(F.sum("slots")).first()[0]
    assert slots.count() == total == slots.select("shard", "place").distinct().count()
    assert mixing.shard_counts(slots).agg(F.sum("slots")).first()[0] == total


# 2 Jaccard -----------------------------------------------------------------------------------------------


def plain_components(rows, n, percent):
    def shingles(text):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(least.get(root(i)))) for i, (doc, _) in enumerate(rows))


def changed(text, seed, times):
    w = text.split(" ")
    for k in range(times):
        w[(seed * 31 + k * 57) % len(w)] = f"new{seed}x{k}"
    return " ".join(w)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join_matches_all_pairs(spark, awkward, n, percent):
    base = sentence(77, 120)
    more = [(100 + k, changed(base, k, 1 + k % 5)) for k in range(120)] + [(300 + k, sentence(500 + k // 3, 12 + k % 3)) for k in range(60)]
    rows = [(i, t) for i, t, _, _ in ROWS] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.linked(docs, n, percent).collect())
    assert got == plain_components(rows, n, percent)


def test_one_of_each_keeps_rows_and_columns(awkward):
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 4 in ids and 5 in ids and None in ids


# 3 language ----------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language.Pieces()
    logp = np.log(np.random.default_rng(3).dirichlet(np.ones(pieces.count + 1), 2).T)
    number = {int(h): int(i) for h, i in zip(pieces.hashes, pieces.numbers)}

    def brute(text, lang):
        if not text:
            return 1.0
        total = 0.0
        for size in range(1, min(len(text), pieces.longest) + 1):
            at = number.get(pieces._hash(text[:size]), pieces.count if size == 1 else None)
            if at is not None:
                total += np.exp(logp[at, lang]) * brute(text[size:], lang)
        return total

    tried = ["the", "ément", "q", "zx漢y"]
    got = pieces.forward(tried, logp)
    for w, row in zip(tried, got):
        assert np.exp(row) == pytest.approx([brute("▁" + w, k) for k in range(2)])


def test_language_of_awkward_rows(awkward, nothing):
    model = language.fit(awkward)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(awkward, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (4, 5, 6, 11))
    assert got[8][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert language.identify(awkward, language.fit(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert language.in_known_language(awkward).columns == awkward.columns


def test_language_accuracy(spark):
    rows = language.op3_language_id(spark, "/root/testdata/sf0.001").filter("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    right = rows.join(lang, "doc_id").filter("lang = lang_pred").count()
    assert right >= 0.95 * rows.count()


# 4 secrets -----------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(['password: "abcdef99"', "API_KEY=abc.def-1", "secret", "token=", "AKIA" + "A1" * 10, "ghp_" + "a" * 40, "deadbeef" * 4, "passwd : x", "é", "\n", " ", "apikey='zzzzzz'",
                                 "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc", "eyJabc.eyJdef." + "x" * 40, "f" * 23, "ſecret=abcdefg", "paſſword"]), max_size=12))
def test_index_finds_what_the_rules_find(parts):
    texts = ["".join(parts), " ".join(parts), ""]
    finders, queries, wanted = secrets._ready(secrets.RULES)
    got = secrets._scan(texts, secrets.RULES, finders, queries, wanted)
    for text, spans in zip(texts, got):
        plain = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text) if m.end(r.group) - m.start(r.group) >= r.least)
        assert spans == plain


def test_redacted_texts_have_no_secret(awkward):
    clean = secrets.redact(awkward)
    assert clean.columns == awkward.columns and clean.count() == len(ROWS)
    assert secrets.find_secrets(clean).filter(F.size("spans") > 0).count() == 0
    row = clean.filter("doc_id = 12").first()
    assert row["text"].startswith("[SECRET]") and row["n_chars"] == len(row["text"]) and "é\U0001f600" in row["text"]


# 7 toxicity ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("common", [0, 12, 256])
def test_nearest_examples_are_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "GROUP", 7)
    rng = np.random.default_rng(7)

    def vector():
        t = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.integers(1, 4, len(t)).astype(float)
        return dict(sorted(zip(t.tolist(), (w / np.sqrt((w * w).sum())).tolist())))

    def arrays(v):
        return np.array(list(v), dtype=np.int64), np.array(list(v.values()))

    examples = [vector() for _ in range(700)]
    index = toxicity.BlockMaxIndex([arrays(e) for e in examples], 40)
    for _ in range(60):
        q = vector()
        brute = sorted((-round(sum(w * e.get(t, 0.0) for t, w in q.items()), 12), i) for i, e in enumerate(examples))
        assert index.nearest(arrays(q), 15) == [(-c, i) for c, i in brute if c < 0][:15]
        first = brute[0][1]
        assert index.nearest(arrays(q), 15, first) == [(-c, i) for c, i in brute if c < 0 and i != first][:15]
    some = [arrays(vector()) for _ in range(20)] + [(np.zeros(0, np.int64), np.zeros(0))]
    assert index.nearest_of(some, 15) == [index.nearest(q, 15) for q in some] and index.nearest(some[-1], 15) == []


def test_isotonic_rises():
    starts, values = toxicity.isotonic([(0.1, 0, 1), (0.1, 1, 1), (0.2, 0, 1), (0.5, 1, 2), (0.9, 1, 1)])
    assert starts == sorted(starts) and values == sorted(values) and values[0] == pytest.approx(1 / 3) and values[-1] == 1.0


def test_toxic_words_are_learned(spark, awkward, nothing):
    texts = [(k, sentence(k, 40) + (" vile scum." if k % 3 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 1) for k in range(0, 200)] + [(3, 0, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[k]["predicted"] == int(k % 3 == 0) for k in range(300)) and got[900]["predicted"] == got[901]["predicted"] == 0
    assert got[3]["evidence"] and got[3]["evidence"][0]["label"] == 1
    assert toxicity.score(nothing, toxicity.fit(docs, labels)).count() == 0
    assert {r["score"] for r in toxicity.score(awkward, toxicity.fit(awkward, labels.filter("doc_id < 0"))).collect()} == {0.0}


# 8 fingerprints ------------------------------------------------------------------------------------------


def test_fingerprints_of_awkward_rows(awkward):
    rows = fingerprints.fingerprints(awkward).collect()
    assert len(rows) == len(ROWS)
    by_text = collections.defaultdict(set)
    for r, (i, t, _, _) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_chars"])), sorted(ROWS, key=lambda r: (r[0] is None, r[0], len(r[1] or "")))):
        assert r["n_chars"] == len(t or "")
        by_text[t or ""].add(tuple(r["fingerprint"]))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("rows, bucket_rows", [(1, 2), (5, 2), (400, 2), (5000, 3)])
def test_next_row_across_buckets(spark, monkeypatch, rows, bucket_rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    ids = [((k * 37) % (3 * rows), f"t{k}") for k in range(rows)]
    docs = spark.createDataFrame(ids, "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: order[(k + 1) % rows][1] for k, (i, _) in enumerate(order)}


def test_edited_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    want = {}
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]).encode()).hexdigest())
    rows = fingerprints.op8_imatch(spark, sf).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == want
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert np.mean([r["near_edited"] for r in rows]) > 5 * np.mean([r["near_next"] for r in rows])


# 9 packing -----------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab Zé.,'\n\t1!\xa0\x85漢🙂\xad", "<|endoftext|>", "'s"]), max_size=40).map("".join))
def test_fast_ids_are_the_tokenizer_s(text):
    assert IDS(text).tolist() == PLAIN(text).tolist()


IDS, PLAIN = packing.Ids(), packing.Ids(ranks=None)
FILE = Tokenizer.from_file(packing.TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "a b", "漢", "é"]), st.characters(exclude_categories=["Cs"])), max_size=20).map("".join))
def test_ids_are_those_of_the_plain_call(text):
    assert IDS(text).tolist() == FILE.encode(text, add_special_tokens=False).ids


def test_long_texts_do_not_fill_a_group(spark):
    docs = spark.createDataFrame([(k, sentence(k, 20_000)) for k in range(4)] + [(k, sentence(k, 30)) for k in range(4, 40)], "doc_id long, text string")
    rows = packing.packed_pieces(docs, capacity=256, group_pieces=16).collect()
    full = [r for r in rows if r["length"] == 256]
    assert len(full) > 200 and len({r["sequence_id"] for r in full}) == len(full) and all(r["offset"] == 0 and r["sequence_id"] < 0 for r in full)
    groups = collections.Counter(r["sequence_id"] >> 32 for r in rows if r["length"] < 256)
    assert max(groups.values()) <= 40 and min(groups) >= 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_sum_of_squares_rule(sizes):
    numbers, offsets = packing.sum_of_squares(np.array(sizes, dtype=np.int64), 32)
    used = collections.Counter()
    for size, number, offset in zip(sizes, numbers, offsets):
        gaps = collections.Counter(32 - u for u in used.values() if u < 32)
        best = None
        for gap in sorted({g for g in gaps if g >= size} | {32}):
            after = gaps.copy()
            after[gap] -= gap != 32 or 0
            if gap == 32:
                after = gaps.copy()
            after[gap - size] += gap != size
            cost = sum(v * v for g, v in after.items() if 0 < g < 32)
            best = min(best, cost) if best is not None else cost
        assert offset == used[number] and used[number] + size <= 32
        used[number] += size
        now = collections.Counter(32 - u for u in used.values() if u < 32)
        assert sum(v * v for v in now.values()) == best


@pytest.mark.parametrize("group_pieces", [4, 1000])
def test_pieces_are_whole_and_gapless(awkward, group_pieces):
    rows = packing.packed_pieces(awkward, 256, group_pieces).collect()
    runs = collections.Counter()
    for i, t, _, _ in ROWS:
        ids = np.append(PLAIN(t or ""), 0).astype("<u4")
        for number, (start, length) in enumerate(packing.pieces_of(len(ids), 256)):
            runs[i, number, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert runs == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    for number in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == number), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def test_sequences_hold_all_tokens(awkward):
    own = awkward.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    total = sum(len(PLAIN(r["text"] or "")) + 1 for r in own.collect())
    sizes = [len(r["ids"]) // 4 for r in packing.packed_sequences(own, 256).collect()]
    assert sum(sizes) == total and max(sizes) <= 256


# 10 quality ----------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(found):
    windows = collections.Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    inside = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    assert quality.repeated_words(found) == len(inside)


def test_cleaning_removes_lines_first(spark, awkward, nothing):
    good = [sentence(k, 30) for k in range(4)]
    text = "\n".join([good[0], "Home | About | Contact", good[1], good[0], "x### y%%% z$$$ q***.", good[2], "", good[3], "BUY NOW TODAY AND SAVE BIG."])
    kept = quality.cleaned(spark.createDataFrame([(1, text, 5, "k")], "doc_id long, text string, n_chars int, kept string")).collect()
    assert kept[0]["text"] == "\n".join([good[0], good[1], good[2], "", good[3]]) and kept[0]["n_chars"] == len(kept[0]["text"])
    rows = {r["doc_id"]: r for r in quality.measure(awkward).collect()}
    assert not rows[4]["kept"] and rows[5]["n_words"] == 0 and rows[9]["n_words"] == 6000
    assert quality.cleaned(awkward).columns == awkward.columns and quality.measure(nothing).count() == 0


# All -----------------------------------------------------------------------------------------------------


def test_empty_tables(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert jaccard.linked(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0
    assert secrets.find_secrets(nothing).count() == 0 and packing.packed_pieces(nothing).count() == 0
    assert fingerprints.fingerprints(nothing).count() == 0 and fingerprints.with_next(nothing, ["text"]).count() == 0
