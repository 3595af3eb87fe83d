"""XML and XBRL documents.

Documents are parsed one per row inside tasks (the standard library's parser):
into element rows of the wanted columns, or into the facts, contexts and units
of a document with its references resolved, so that no join has to bring rows of
one document together again.  Everything after that is expressions, joins and
aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.functions.finance import (
    concept_words,
    humanize_concept,
    plain_period_label,
    reported_period_label,
    scaled_number,
    short_uri,
)
from tablescope.functions.text import squeeze, squeezed, truncate
from tablescope.functions.values import packed_number, parse_packed, plain_number
from tablescope.operators.facts import told_concept
from tablescope.session import stored

# Names of inline facts, link elements and their arcs.
INLINE_FACTS = ("nonFraction", "nonNumeric")
LINKBASES = (
    ("calculationLink", "calculationArc", "Calculation"),
    ("presentationLink", "presentationArc", "Presentation"),
    ("definitionLink", "definitionArc", "Definition"),
    ("referenceLink", "referenceArc", "Reference"),
)
BAD_XML = "Not well-formed XML."

# Elements whose descendants are read as a unit, and leaves read with all text.
_SCOPES = frozenset({"context", "unit", "labelLink", *(link for link, _, _ in LINKBASES)})
_LEAVES = frozenset({*INLINE_FACTS, "explicitMember", "measure", "identifier", "startDate", "endDate",
                     "instant", "label"})
ELEMENT_SCHEMA = (
    "node_id long, parent_id long, scope_id long, scope string, path string, tag string, name string, "
    "text string, content string, attrs map<string,string>, attribute_list array<string>, depth int, "
    "child_count int, error string"
)
_NAMES = [part.split()[0] for part in ELEMENT_SCHEMA.split(", ")]
_ARROW_TYPES = (
    *[pa.int64()] * 3, *[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.list_(pa.string()),
    pa.int32(), pa.int32(), pa.string(),
)
_TYPES = dict(zip(_NAMES, _ARROW_TYPES))
_BATCH_ROWS = 10_000
#: Columns that the readings of linkbases use.
LINK_COLUMNS = ("node_id", "parent_id", "scope_id", "scope", "name", "content", "attrs")
_DATES = {"startDate": 0, "endDate": 1, "instant": 2, "identifier": 3}  # place among the fields
_TELLING = frozenset({*_SCOPES, *INLINE_FACTS, *_DATES, "explicitMember", "measure", "divide"})
_CONTEXT_FIELDS = ("period", "start", "end", "instant", "entity", "dimensions")
_FACT_FIELDS = ("fact_no", "inline", "concept", "words", "statement", "raw", "number", "context_id", "unit_id", "scale",
                "sign", "decimals")
_SHAPE_FIELDS = dict.fromkeys(("fact_count", "arc_count", "label_count", "element_count"), pa.int64())


def _tree(text: str) -> Element:
    """Root element of a document; names keep their prefixes."""
    builder, parser = TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = builder.start, builder.end
    parser.CharacterDataHandler = builder.data
    parser.Parse(text, True)
    return builder.close()


def _walk(root: Element) -> Iterator[tuple]:
    """Elements in document order: element, name, number, parent's number, scope's number and name, path, depth."""
    waiting = [(root, None, None, None, "", 0)]
    number = 0
    while waiting:
        node, parent, scope_id, scope, above, depth = waiting.pop()
        name = node.tag.rpartition(":")[2]
        if name in _SCOPES:
            scope_id, scope = number, name
        path = f"{above}/{name}"
        yield node, name, number, parent, scope_id, scope, path, depth
        if len(node):
            waiting += [(child, number, scope_id, scope, path, depth + 1) for child in reversed(node)]
        number += 1


def _own_text(node: Element) -> str:
    """Text of an element, with a blank in the place of each child."""
    own = node.text or ""
    return own + "".join([" " + (child.tail or "") for child in node]) if len(node) else own


def _all_text(node: Element) -> str:
    return "".join(node.itertext()) if len(node) else node.text or ""


def _element_rows(root: Element, wanted: Sequence[str]) -> list[tuple]:
    """Wanted columns of the elements of a document."""
    if not wanted:
        return [()] * sum(1 for _ in root.iter())
    nodes, names, ids, parents, scope_ids, scopes, paths, depths = zip(*_walk(root))
    made = {
        "node_id": lambda: ids, "parent_id": lambda: parents, "scope_id": lambda: scope_ids, "scope": lambda: scopes,
        "path": lambda: paths, "tag": lambda: [e.tag for e in nodes], "name": lambda: names,
        "text": lambda: [_own_text(e) for e in nodes],
        "content": lambda: [_all_text(e) if name in _LEAVES or e.get("contextRef") else None for e, name in zip(nodes, names)],
        "attrs": lambda: [e.items() for e in nodes],
        "attribute_list": lambda: [[f'{k}="{v}"' for k, v in e.items()] for e in nodes],
        "depth": lambda: depths, "child_count": lambda: [len(e) for e in nodes],
        "error": lambda: [None] * len(nodes),
    }
    return [*zip(*[made[k]() for k in wanted])]


@lru_cache(maxsize=4096)
def _told(tag: str) -> str:
    """Name without prefix of an element that tells of facts by itself, else nothing."""
    name = tag.rpartition(":")[2]
    return name if name in _TELLING else ""


def _reported(text: str) -> tuple[list[list], dict[str, list], dict[str, list]]:
    """Facts, contexts and units of a document as they stand there; of equal ids the last counts.

    They are read while the document is parsed, without a tree.
    """
    facts: list[list] = []  # inline, tag, text, and the attributes that tell of a fact
    contexts: list[tuple] = []
    units: list[tuple] = []
    scope, entry = "", []  # the scope around, and what it tells
    ends: list[tuple | None] = []  # of each open element: the scope around, and where its text goes
    pieces: list[str] = []  # all text so far

    def start(tag: str, attrs: dict[str, str]) -> None:
        nonlocal scope, entry
        name = _told(tag)
        refers = bool(attrs) and attrs.get("contextRef", "") != ""
        if not (name or refers):
            ends.append(None)
            return
        outer = fact = None
        values, place = entry, -1
        if name in _SCOPES:
            outer, scope = (scope, entry), name
            if name == "context":
                entry = [None, None, None, None, [], []]
                contexts.append((attrs.get("id"), entry))
            elif name == "unit":
                entry = [[], False]
                units.append((attrs.get("id"), entry))
        elif scope == "context":
            if name in _DATES:
                if entry[_DATES[name]] is None:  # the first counts
                    place = _DATES[name]
                    entry[place] = ""
            elif name == "explicitMember":
                entry[4].append(attrs.get("dimension", ""))
                values, place = entry[5], len(entry[5])
                values.append("")
        elif scope == "unit":
            if name == "measure":
                values, place = entry[0], len(entry[0])
                values.append("")
            elif name == "divide":
                entry[1] = True
        inline = name in INLINE_FACTS
        if inline or (refers and name not in ("context", "unit")):
            get = attrs.get
            fact = [inline, tag, "", get("name", ""), get("contextRef", ""), get("unitRef", ""),
                    get("scale", ""), get("sign", ""), get("decimals", "")]
            facts.append(fact)
        ends.append((outer, values, place, fact, len(pieces)))

    def end(_: str) -> None:
        nonlocal scope, entry
        found = ends.pop()
        if found is None:
            return
        outer, values, place, fact, begin = found
        if place >= 0:
            values[place] = "".join(pieces[begin:])
        if fact is not None:
            fact[2] = "".join(pieces[begin:])
        if outer is not None:
            scope, entry = outer

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, pieces.append
    parser.Parse(text, True)
    return facts, {key: entry for key, entry in contexts if key}, {key: entry for key, entry in units if key and entry[0]}


@lru_cache(maxsize=4096)
def _words(name: str) -> str:
    return concept_words(name)


@lru_cache(maxsize=4096)
def _concept(name: str) -> tuple[str, str]:
    return told_concept(name)


def _context(entry: list) -> tuple:
    """Fields of a context: period, dates, entity, and its axes with their members in words.

    Dates are given where expressions have to make the period of them.
    """
    start, end, instant, entity = [squeezed(text) if text else "" for text in entry[:4]]
    shown = [f"{_words(axis)}: {words}" if axis else words
             for axis, words in zip(entry[4], [_words(squeezed(member)) for member in entry[5]])]
    period = plain_period_label(start, end, instant)
    dates = (start, end, instant) if period is None else (None, None, None)
    return period, *dates, entity, "; ".join(shown)


def _unit(entry: list) -> str:
    """Measures of a unit multiplied, or divided by those after the first."""
    names = [squeezed(name) for name in entry[0]]
    return f"{names[0]} / {' x '.join(names[1:])}" if entry[1] and len(names) >= 2 else " x ".join(names)


def _fact_rows(text: str) -> list[tuple]:
    """Facts of a document, each with the fields of its context and its unit, which are read once."""
    facts, contexts, units = _reported(text)
    of_context = {key: _context(entry) for key, entry in contexts.items()}
    of_unit = {key: _unit(entry) for key, entry in units.items()}
    unknown = (None,) * len(_CONTEXT_FIELDS)
    rows = []
    for inline, tag, raw, name, context, unit, scale, sign, decimals in facts:
        concept, raw = name if inline else tag, squeezed(raw)
        rows.append((len(rows) + 1, inline, concept, *_concept(concept), raw, plain_number(raw), context, unit, scale, sign, decimals,
                     *of_context.get(context, unknown), of_unit.get(unit)))
    return rows


def _link(node: Element, name: str) -> str:
    return node.get(f"xlink:{name}") or node.get(name) or ""


def _shape_rows(text: str) -> list[tuple]:
    """One row: numbers of facts, arcs, labels and elements."""
    root = _tree(text)
    arc_of = {link: arc for link, arc, _ in LINKBASES}
    facts = arcs = count = 0
    starts, resources = [], {}
    for node, name, _, parent, scope_id, scope, _, _ in _walk(root):
        count += 1
        facts += name in INLINE_FACTS or bool(node.get("contextRef") and name not in ("context", "unit"))
        if scope is not None and parent == scope_id:
            arcs += arc_of.get(scope) == name
            if scope == "labelLink" and name == "labelArc":
                starts.append((scope_id, _link(node, "to")))
            elif scope == "labelLink" and name == "label":
                key = (scope_id, _link(node, "label"))
                resources[key] = resources.get(key, 0) + bool(key[1])
    return [(facts, arcs, sum(resources.get(key, 0) for key in starts), count)]


def _parsed(
    documents: DataFrame, read: Callable[[str], list[tuple]], types: dict[str, pa.DataType], schema: str,
    text: str = "text", doc: str = "doc_id",
) -> DataFrame:
    """Rows that ``read`` gives for each well-formed document; the others give a row with their ``error``, if asked for."""
    id_type = documents.schema[doc].dataType.simpleString()
    names = list(types)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys: list = []
            rows: list[tuple] = []

            def done() -> pa.RecordBatch:
                arrays = [pa.array(keys, key_type), *map(pa.array, zip(*rows), types.values())]
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = read(source or "")
                except expat.ExpatError as problem:
                    if "error" not in types:
                        continue
                    known = {"node_id": -1, "error": f"{BAD_XML} ({problem})"}
                    found = [tuple([known.get(name) for name in names])]
                keys += [key] * len(found)
                rows += found
                if len(keys) >= _BATCH_ROWS:
                    yield done()
                    keys, rows = [], []
            if keys:
                yield done()

    wanted = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text"))
    return wanted.mapInArrow(parse, ", ".join(filter(None, [f"doc_id {id_type}", schema])))


def parse_documents(
    documents: DataFrame, text: str = "text", doc: str = "doc_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """All elements of XML documents ``(doc_id, text)``; no cap on their number.

    A document that is not well-formed gives one row with ``error``.  Only the
    columns named are made; without ``error`` among them, such documents give no row.
    """
    wanted = tuple(_NAMES if columns is None else columns)
    schema = ", ".join(part for part in ELEMENT_SCHEMA.split(", ") if part.split()[0] in wanted)
    wanted = tuple(name for name in _NAMES if name in wanted)
    return _parsed(documents, lambda source: _element_rows(_tree(source), wanted), {k: _TYPES[k] for k in wanted}, schema, text, doc)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text files as documents; the path is the document's id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def xml_elements(parsed: DataFrame) -> DataFrame:
    """Elements of the well-formed documents."""
    return parsed.filter(F.col("error").isNull()).drop("error")


def stored_links(documents: DataFrame) -> DataFrame:
    """Elements for the readings of linkbases, written once to the shared
    folder, as each reading joins several kinds of them."""
    return stored(parse_documents(documents, columns=LINK_COLUMNS))


def xml_issues(parsed: DataFrame) -> DataFrame:
    """Documents that could not be read."""
    return parsed.filter(F.col("error").isNotNull()).select("doc_id", F.col("error").alias("message"))


def flatten_xml(elements: DataFrame, limit: int | None = None) -> DataFrame:
    """Elements as a plain table: path, name, own text, attributes, depth, children.

    Texts are whole; ``limit`` shortens them for display.
    """
    text = squeeze(F.col("text"))
    return elements.select(
        "doc_id", "node_id", F.col("path").alias("Path"), F.col("name").alias("Element"),
        (truncate(text, limit) if limit else text).alias("Text"),
        F.array_join("attribute_list", " ").alias("Attributes"),
        F.col("depth").alias("Depth"), F.col("child_count").alias("Child Count"),
    )


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _xlink(name: str) -> Column:
    return F.coalesce(
        F.try_element_at("attrs", F.lit(f"xlink:{name}")), F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _strings(*names: str) -> dict[str, pa.DataType]:
    return dict.fromkeys(names, pa.string())


def _period() -> Column:
    """Period of a context; null where there is none."""
    made = reported_period_label(*(F.col(f"`{k}`") for k in ("start", "end", "instant")))
    return F.when(F.col("dimensions").isNotNull(), F.coalesce("period", made))


def xbrl_contexts(documents: DataFrame) -> DataFrame:
    """Contexts by id: period, entity, dimensions (S9).  The last of equal ids counts."""
    types = _strings("context_id", *_CONTEXT_FIELDS)

    def read(text: str) -> list[tuple]:
        return [(key, *_context(entry)) for key, entry in _reported(text)[1].items()]

    found = _parsed(documents, read, types, ", ".join(f"{k} string" for k in types))
    return found.select("doc_id", "context_id", _period().alias("period"), "entity", "dimensions")


def xbrl_units(documents: DataFrame) -> DataFrame:
    """Units by id: measures multiplied, or divided by those after the first."""
    def read(text: str) -> list[tuple]:
        return [(key, _unit(entry)) for key, entry in _reported(text)[2].items()]

    return _parsed(documents, read, _strings("unit_id", "unit"), "unit_id string, unit string")


def xbrl_facts(documents: DataFrame) -> DataFrame:
    """Reported facts with period, unit and amount.

    A fact refers to contexts and units of its own document; they are resolved
    where the document is parsed, so that no fact is shuffled.
    """
    c = F.col
    types = _strings(*_FACT_FIELDS, *_CONTEXT_FIELDS, "unit") | {"fact_no": pa.int64(), "inline": pa.bool_(), "number": pa.float64()}
    kinds = {"fact_no": "long", "inline": "boolean", "number": "double"}
    rows = _parsed(documents, _fact_rows, types, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in types))
    # What an expression reads several times becomes a column first, or it would be worked out each time.
    rows = rows.withColumns({"period": _period(), "_packed": F.when(c("number").isNull(), packed_number(c("raw")))})
    rows = rows.withColumn("number", F.coalesce("number", parse_packed(c("_packed"))))
    rows = rows.withColumn("amount", scaled_number(c("number"), c("scale"), c("sign")))

    def part(prefix: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(prefix), value))

    note = F.concat_ws(
        " | ", part("context ", c("context_id")), part("decimals ", c("decimals")), part("scale ", c("scale")),
        part("", c("dimensions")),
        F.when(c("amount").isNull(), part("value: ", c("raw"))),
    )
    return rows.select(
        "doc_id", c("doc_id").cast("string").alias("sheet"), "statement",
        F.coalesce(F.nullif("dimensions", F.lit("")), "entity", F.lit("")).alias("section"),
        F.when(c("words") != "", c("words")).when(c("concept") != "", c("concept"))
        .otherwise(F.format_string("Fact %d", c("fact_no"))).alias("line_item"),
        F.when(c("concept") != "", c("concept")).otherwise("Fact").alias("metric"),
        F.coalesce("period", F.lit("Unspecified period")).alias("period"), "amount",
        F.coalesce("unit", "unit_id").alias("unit"), note.alias("note"),
        F.concat(F.when(c("inline"), "Inline fact ").otherwise("Fact "), c("fact_no").cast("string")).alias("source_row"),
        c("fact_no").alias("row_no"),
    )


def _locators(elements: DataFrame) -> DataFrame:
    """Locators by link and label; the last of equal labels counts."""
    c = F.col
    locs = elements.filter((c("name") == "loc") & (c("parent_id") == c("scope_id"))).select(
        "doc_id", "scope_id", _xlink("label").alias("label"), _xlink("href").alias("href"), "node_id"
    ).filter((c("label") != "") & (c("href") != ""))
    return locs.groupBy("doc_id", "scope_id", "label").agg(F.max_by("href", "node_id").alias("href"))


def _links(elements: DataFrame) -> DataFrame:
    role = _xlink("role")
    words = short_uri(role)
    return elements.filter(F.col("node_id") == F.col("scope_id")).select(
        "doc_id", "scope_id", "scope", F.when(words != "", words).otherwise(role).alias("role"))


def _arc_rows(elements: DataFrame, arc_of: dict[str, str]) -> DataFrame:
    c = F.col
    wanted = None
    for link, arc in arc_of.items():
        hit = (c("scope") == link) & (c("name") == arc)
        wanted = hit if wanted is None else wanted | hit
    return elements.filter(wanted & (c("parent_id") == c("scope_id"))).select(
        "doc_id", "scope_id", "scope", "node_id", _xlink("from").alias("_from"), _xlink("to").alias("_to"),
        _attr("weight").alias("weight"), _attr("order").alias("order"), _xlink("arcrole").alias("arcrole"),
        _xlink("preferredLabel").alias("_preferred"),
    ).join(_links(elements).select("doc_id", "scope_id", "role"), ["doc_id", "scope_id"])


def xbrl_arcs(elements: DataFrame) -> DataFrame:
    """Calculation, presentation, definition and reference arcs."""
    c = F.col
    arcs = _arc_rows(elements, {link: arc for link, arc, _ in LINKBASES})
    locs = _locators(elements)
    start = locs.select("doc_id", "scope_id", c("label").alias("_from"), c("href").alias("_from_href"))
    end = locs.select("doc_id", "scope_id", c("label").alias("_to"), c("href").alias("_to_href"))
    rows = arcs.join(start, ["doc_id", "scope_id", "_from"], "left").join(
        end, ["doc_id", "scope_id", "_to"], "left").na.fill("", ["_from_href", "_to_href"])
    title = None
    for link, _, label in LINKBASES:
        hit = c("scope") == link
        title = F.when(hit, label) if title is None else title.when(hit, label)
    relation = short_uri(c("arcrole"))
    return rows.select(
        "doc_id", "node_id", title.alias("linkbase"), "role",
        F.when(relation != "", relation).otherwise(title).alias("relationship"),
        humanize_concept(c("_from_href")).alias("from_concept"), humanize_concept(c("_to_href")).alias("to_concept"),
        F.lit("").alias("label"), "weight", "order", "arcrole", short_uri(c("_preferred")).alias("preferred_label"),
        F.lit("").alias("language"), c("_from_href").alias("from_href"), c("_to_href").alias("to_href"),
    )


def xbrl_labels(elements: DataFrame) -> DataFrame:
    """Labels of concepts, one row per label resource."""
    c = F.col
    arcs = _arc_rows(elements, {"labelLink": "labelArc"})
    start = _locators(elements).select("doc_id", "scope_id", c("label").alias("_from"), c("href").alias("_from_href"))
    resources = elements.filter(
        (c("scope") == "labelLink") & (c("name") == "label") & (c("parent_id") == c("scope_id"))
    ).select(
        "doc_id", "scope_id", _xlink("label").alias("_to"), c("node_id").alias("_label_node"),
        squeeze(c("content")).alias("label"), _xlink("role").alias("_label_role"),
        _attr("xml:lang").alias("language"),
    ).filter(c("_to") != "")
    rows = arcs.join(start, ["doc_id", "scope_id", "_from"], "left").join(
        resources, ["doc_id", "scope_id", "_to"]).na.fill("", ["_from_href"])
    relation = short_uri(c("arcrole"))
    return rows.select(
        "doc_id", "node_id", F.lit("Label").alias("linkbase"), "role",
        F.when(relation != "", relation).otherwise("Concept label").alias("relationship"),
        humanize_concept(c("_from_href")).alias("from_concept"), F.lit("").alias("to_concept"), "label",
        F.lit("").alias("weight"), "order", "arcrole", short_uri(c("_label_role")).alias("preferred_label"),
        "language", c("_from_href").alias("from_href"), F.lit("").alias("to_href"),
    )


def xml_shapes(documents: DataFrame) -> DataFrame:
    """Shape of each document: facts, linkbase or generic."""
    c = F.col
    rows = _parsed(documents, _shape_rows, _SHAPE_FIELDS, ", ".join(f"{k} long" for k in _SHAPE_FIELDS))
    shape = F.when(c("fact_count") > 0, "facts").when(
        c("arc_count") + c("label_count") > 0, "linkbase").otherwise("generic")
    return rows.withColumn("shape", shape)


def xml_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a corpus, each with the documents of its shape."""
    shapes = xml_shapes(documents).select("doc_id", "shape")

    def only(shape: str) -> DataFrame:
        return documents.join(shapes.filter(F.col("shape") == shape).select("doc_id"), "doc_id", "left_semi")

    links = parse_documents(only("linkbase"), columns=LINK_COLUMNS)
    return {
        "facts": xbrl_facts(documents),  # a document with a fact has that shape
        "linkbase": xbrl_arcs(links).unionByName(xbrl_labels(links)),
        "generic": flatten_xml(xml_elements(parse_documents(only("generic")))),
    }
