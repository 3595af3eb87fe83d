"""Snapshot collapse and separator scan against plain versions."""

import collections

import numpy as np
import pytest

from tablescope.llm import chats, token_counts

from .conftest import ROWS
from .test_text_operators import PLAIN


def plain_chats(turns):
    held = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        held[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    whole = {c: tuple((r[1] if r[0] else "unknown", t[1]) for _, r, t in sorted(v)) for c, v in held.items()}
    inner = {v[:k] for v in whole.values() for k in range(1, len(v))}
    equal = collections.defaultdict(list)
    for c, v in whole.items():
        if v not in inner:
            equal[v].append(c)
    out = []
    for v, convs in equal.items():
        name = min((c for c in convs if c is not None), default=None)
        out.append((str(name), len(v), len(convs), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)))
    return sorted(out)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
    (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 11, "user", "bye"), (4, 0, "user", "hi"), (5, 0, None, None), (5, 0, None, None),
    (6, 0, "unknown", ""), (None, 1, "user", "lone"), (None, 2, "user", "turns"), (7, None, "user", "x" * 5000), (8, 0, "assistant", "hi"),
    (9, 0, "user", "ab"), (9, 1, "user", "c"), (10, 0, "user", "a"), (10, 1, "user", "bc"),
    (11, 0, "tool", "z"), (11, 0, None, "z"), (11, 0, "tool", None), (11, 0, "assistant", "b"), (12, 0, "assistant", "b"), (12, 0, None, "z"),
    (13, None, "user", "q"), (13, None, "user", "b"), (13, None, "user", "b"), (14, None, "user", "b"), (14, None, "user", "b"),
] + [(20 + k, t, "user", f"t{t}") for k in range(6) for t in range(k + 1)] + [(40 + k, t, "user", f"s{t}") for k in (0, 1) for t in range(9000)]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, place int").repartition(3)


@pytest.mark.parametrize("block", [2, 4096])
def test_maximal_conversations(turns, monkeypatch, block):
    monkeypatch.setattr(chats, "BLOCK", block)
    rows = turns if block > 2 else turns.filter("conv_id is null or conv_id < 40")
    want = plain_chats([t for t in TURNS if block > 2 or t[0] is None or t[0] < 40])
    # the null conversation keeps its own rows
    got = sorted((str(r["conv_id"]), r["n_turns"], r["copies"], r["text"]) for r in chats.rendered(rows).collect())
    assert got == want
    assert chats.rendered(turns.filter("conv_id < 0")).count() == 0


def test_token_counts_of_awkward_rows(spark, awkward, nothing):
    want = sorted((str(i), len(PLAIN(t or ""))) for i, t, _, _ in ROWS)
    for block in (7, 1 << 17):
        blocks = token_counts.flat_blocks(awkward, block).cache()
        counts = collections.Counter(n for _, n in want)
        assert collections.Counter(r["tokens"] for r in token_counts.document_lengths(blocks).collect()) == counts
        assert sum(len(r["doc_ids"]) for r in blocks.collect()) == len(ROWS)
    assert token_counts.document_lengths(token_counts.flat_blocks(nothing)).count() == 0


def test_counts_by_document(spark, tmp_path, awkward):
    awkward.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["tokens"]) for r in token_counts.op6_token_counts(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), len(PLAIN(t or ""))) for i, t, _, _ in ROWS)


@pytest.mark.parametrize("block", [1, 5, 64])
def test_flat_files(spark, tmp_path, block):
    rng, want = np.random.default_rng(4), {}
    for k in range(3):
        ids = rng.integers(0, 4, 200).astype("<u2")
        ids.tofile(tmp_path / f"f{k}.bin")
        ends = np.flatnonzero(ids == 3)
        want |= {(k, d): int(n) for d, n in enumerate(np.diff(np.append(-1, ends)) - 1)}
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = token_counts.document_lengths(token_counts.file_blocks(spark, str(tmp_path), block), separator=3).collect()
    assert {(int(r["file"][-5]), r["document"]): r["tokens"] for r in rows} == want
