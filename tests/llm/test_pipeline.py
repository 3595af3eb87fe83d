"""The pipeline's stages against plain versions, each over what its predecessor kept."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tablescope.llm import language, packing, secrets
from tablescope.llm.common import documents, fold, stored

from .test_text_operators import PLAIN, plain_components, plain_targets, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()], docs))
        docs = out
    return found


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language_stage(steps):
    before, after, docs = steps[0]
    scorer = language.Scorer(language.fit(docs.filter(fold("doc_id", 3) != 1)))
    keep = {r["doc_id"] for r in before for lang, score in [tuple(x[0] for x in scorer([r["text"] or ""]))] if lang != "und" and score >= 0.5}
    assert by_id(after) == {i: r for i, r in by_id(before).items() if i in keep} and len(keep) > 0.95 * len(before)


def test_near_duplicate_stage(steps):
    before, after, _ = steps[1]
    heads = {c for _, _, c in plain_components([(r["doc_id"], r["text"]) for r in before], 5, 80)}
    assert by_id(after) == {i: r for i, r in by_id(before).items() if str(i) in heads} and len(after) < len(before)


def test_secret_stage(steps):
    before, after, _ = steps[2]
    for i, r in by_id(before).items():
        spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, r["text"] or "") if m.end(rule.group) - m.start(rule.group) >= rule.least)
        text, at = "", 0
        for start, end in spans:
            if start >= at:
                text += r["text"][at:start] + "[SECRET]"
            at = max(at, end)
        text += (r["text"] or "")[at:]
        assert by_id(after)[i] == r | {"text": text, "n_chars": len(text)}
    assert len(after) == len(before)


def test_mixing_stage(steps):
    before, after, _ = steps[3]
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
        own = by_id(before)[r["doc_id"]]
        rest = iter(words(own["text"]))
        assert all(w in rest for w in words(r["text"])) and r["n_chars"] == len(r["text"])
    for source, goal in plain_targets(sizes).items():
        assert abs(taken[source] - goal) <= 1
    assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 3


def test_packing_stage(steps):
    before, after, _ = steps[4]
    runs, used = collections.Counter(), collections.defaultdict(list)
    for r in before:
        ids = np.append(PLAIN(r["text"]), 0).astype("<u4")
        for number, (start, length) in enumerate(packing.pieces_of(len(ids), 2048)):
            runs[r["doc_id"], number, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert runs == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after)
    for r in after:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= 1.05 * sum(r["length"] for r in after) / 2048 + 1


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_stages_take_awkward_rows(spark, request, table):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert (docs.count() > 0) == (table == "awkward")
