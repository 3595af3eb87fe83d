"""Flattened XML against a second parser."""

from collections import Counter
from xml.etree import ElementTree

import __spark_entry__ as entry
from workloads import documents

SF = "/root/testdata/sf0.001"


def test_every_element_is_flattened(spark):
    def walk(element, above):
        path = f"{above}/{element.tag}"
        yield path, len(list(element)), path.count("/") - 1, " ".join(f'{k}="{v}"' for k, v in element.attrib.items())
        for child in element:
            yield from walk(child, path)

    expected = Counter()
    for doc, text in documents.instances(spark, SF).select("doc_id", "text").toLocalIterator():
        plain = text.replace("<ifrs-full:", "<").replace("</ifrs-full:", "</").replace("ix:nonFraction", "nonFraction")
        expected.update((doc, *e) for e in walk(ElementTree.fromstring(plain), ""))
    got = Counter((r["doc_id"], r["Path"], r["Child Count"], r["Depth"], r["Attributes"]) for r in entry.queries()["flatten_xml"](spark, SF).collect())
    assert got == expected
