"""The toxicity model's terms and its results on held-out labels."""

import pytest

from tablescope.llm import toxicity
from tablescope.llm.common import documents


def test_all_terms_count_and_those_of_the_label_most(spark):
    marks = " ".join(f"mark{k}" for k in range(5_000))
    docs = spark.createDataFrame([(k, f"plain words {marks if k % 2 else 'only'}") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.terms) == {"plain", "words", "only", *(f"mark{k}" for k in range(5_000))}
    assert model.weights[model.terms["mark7"]] > 10 * model.weights[model.terms["plain"]] > 0


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind(spark, label):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(30)], "doc_id int, text string")
    labels = spark.createDataFrame([(k, label) for k in range(20)], "doc_id int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r["score"] for r in rows} == {float(label)} and all(len(r["evidence"]) == 15 for r in rows)


@pytest.mark.parametrize("size, most_missed, most_false", [("0.01", 0.25, 0.05), ("0.1", 0.1, 0.02)])
def test_held_out_labels(spark, size, most_missed, most_false):
    """Recall and false alarms on the fold that is not learned from; prints the README's figures by language (-s)."""
    sf = f"/root/testdata/sf{size}"
    truth = {r["doc_id"]: r["toxic"] for r in documents(spark, sf, "labels").collect()}
    language = {r["doc_id"]: r["lang"] for r in documents(spark, sf).select("doc_id", "lang").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, sf).collect()]
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [r for r in held if truth[r["doc_id"]]], [r for r in held if not truth[r["doc_id"]]]
    for lang in sorted({language[r["doc_id"]] for r in toxic}, key=str):
        mine = [r["predicted"] for r in toxic if language[r["doc_id"]] == lang]
        print(size, lang, sum(mine), "of", len(mine), "found")
    print(size, "found", sum(r["predicted"] for r in toxic), "of", len(toxic), "false", sum(r["predicted"] for r in clean), "of", len(clean),
          "distinct scores", len({r["score"] for r in rows}), "without evidence", sum(r["evidence"] == "[]" for r in rows), "of", len(rows))
    assert sum(1 - r["predicted"] for r in toxic) <= most_missed * len(toxic)
    assert sum(r["predicted"] for r in clean) <= most_false * len(clean)
    assert len({r["score"] for r in rows}) > 10 and sum(r["evidence"] == "[]" for r in rows) < 0.05 * len(rows)
