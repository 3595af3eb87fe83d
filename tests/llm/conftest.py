"""A small table with every awkward row, shared by the tests of the text operators."""

import pytest

WORDS = "the and of haing tionhe wher anonti erhaan stble onre thly edou in ennt shea with from that this are".split()


def sentence(seed: int, words: int) -> str:
    state, out = seed * 7919 + 17, []
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state // 65536 % len(WORDS)] + WORDS[state // 256 % 11][:2])
    return " ".join(out) + "."


ROWS = [
    (1, sentence(1, 80), "en", "a"), (2, sentence(1, 80), "en", "a"), (3, sentence(1, 79)[:-1] + " other.", "en", "b"),
    (4, None, "en", "a"), (5, "", "de", "b"), (6, "   \n\t ", None, "b"), (7, "one", "en", None), (8, "ein zwei drei", "de", None),
    (9, sentence(9, 6000), "en", "c"), (10, "\n".join(sentence(k, 9) for k in range(9)), "fr", "c"), (11, "12 34 --- ###", "fr", "c"),
    (12, 'token = "abcdef123456" and AKIA' + "Z" * 20 + " é\U0001f600 " + "0123456789abcdef" * 2, "en", "a"),
    (None, sentence(13, 60), "en", "a"), (13, sentence(13, 60), "en", "b"), (1, sentence(1, 80), "en", "a"), (14, "Straße  ÉTÉ naïve   x y", "de", "d"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rows = [(i, t, l, s, None if t is None else len(t), 0.5, "x", 7) for i, t, l, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, size int").coalesce(2)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id < 0")
