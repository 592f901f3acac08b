"""Transforms that make canonical records: events, facts and entities, graphs, verdicts."""

from __future__ import annotations

from calendar import month_name
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import exprs as X
from ledgerline.operators.textchecks import numbered

_MONTHS = "|".join(m if len(m) < 4 else f"{m[:3]}(?:t(?:{m[4:]})?)?" if m[3] == "t" else f"{m[:3]}(?:{m[3:]})?" for m in month_name[1:])
DATE_PATTERNS = (r"\b\d{4}-\d{2}-\d{2}\b", *(rf"\b\d{{1,2}}{x}\d{{1,2}}{x}\d{{2,4}}\b" for x in "/-"), rf"(?i)\b(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b")
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
AMOUNT_PATTERN = rf"(?i)(?:[$€£]\s?{_NUMBER}|\b{_NUMBER}\s?(?:USD|ETB|birr|dollars?)\b)"
ACRONYM_PATTERN = r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b"
PHRASE_PATTERN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}"
PERSON_PATTERN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"
#: Parts of words that make a phrase an organisation; words that no such phrase has.
ORGANISATION = tuple(sorted("agency association authority bank board bureau college commission committee company corp corporation council department inc institute ltd ministry office school university".split()))
PLACES = ("addis ababa", "africa", "ethiopia", "kenya", "nairobi", "tanzania", "uganda")
STOP = tuple(sorted("about and document figure for from into onto or over page table that the these this those under with".split()))
HEADINGS = tuple(sorted("abstract appendix background chapter conclusion conclusions contents discussion essay figure guideline introduction methodology proposal recommendations references research results section table".split()))
#: What a stream's first part stands for, and who writes it.
STREAM_TYPES = {"agent": "AgentSession", "audit": "AuditLedger", "compliance": "ComplianceRecord", "credit": "CreditRecord", "docpkg": "DocumentPackage", "fraud": "FraudScreening", "loan": "LoanApplication"}
SERVICES = {"agent": "agent-runtime", "audit": "audit-service", "compliance": "compliance-engine", "credit": "credit-analysis", "docpkg": "document-management", "fraud": "fraud-screening", "loan": "loan-origination"}
RELATIONS = {
    "READS": ("read", "reads", "select", "join", "cte", "config", "python_read"), "WRITES": ("write", "writes", "python_write"), "IMPORTS": ("import", "imports"),
    "CALLS": ("call", "calls", "macro_call"), "PRODUCES": ("produce", "produces"), "CONSUMES": ("consume", "consumes"),
}


def sequenced(df: DataFrame, stream: str, order: Sequence[str]) -> DataFrame:
    """sequence_number from 0 in each stream, in arrival order; a stream of many rows is numbered in ranges."""
    return numbered(df, order, "_number", [stream]).withColumn("sequence_number", (F.col("_number") - 1).cast("int")).drop("_number")


def positioned(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """global_position from 1 over all rows."""
    return numbered(df, order, "global_position")


def stream_parts(stream: Column) -> tuple[Column, Column]:
    """(kind, id) of a stream's name, cut at its first dash; without one both are the name."""
    parts = F.split(stream, "-", 2)
    return parts[0], F.when(F.size(parts) > 1, parts[1]).otherwise(stream)


def first_of(*values: Column, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    out = F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
    return F.coalesce(out, F.lit(default)) if default is not None else out


def _looked_up(key: Column, values: Mapping[str, str], otherwise: Column) -> Column:
    if not values:
        return otherwise
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], otherwise)


def event_records(df: DataFrame, order: Sequence[str], types: Mapping[str, str] = STREAM_TYPES, services: Mapping[str, str] = SERVICES) -> DataFrame:
    """Canonical events from stream_id, event_type, event_version, payload (JSON text), recorded_at."""
    kind, key = stream_parts(F.col("stream_id"))
    seq = sequenced(df, "stream_id", order)
    at = lambda p: F.get_json_object("payload", f"$.{p}")
    return seq.select(
        X.uuid5(F.concat_ws(":", "stream_id", F.col("sequence_number").cast("string"), "event_type")).alias("event_id"),
        "event_type", X.uuid5(F.concat_ws(":", F.lit("aggregate"), kind, key)).alias("aggregate_id"), _looked_up(kind, types, X.title(kind)).alias("aggregate_type"), "sequence_number",
        X.uuid5(F.concat(F.lit("correlation:"), first_of(at("application_id"), at("session_id"), F.col("stream_id")))).alias("correlation_id"),
        first_of(*[at(k) for k in ("user_id", "actor_id", "officer_id", "agent_id", "requested_by")], default="system").alias("user_id"),
        _looked_up(kind, services, F.lit("unknown")).alias("source_service"), F.col("stream_id").alias("original_stream_id"),
        X.dotted_version(F.col("event_version")).alias("schema_version"), "recorded_at",
    )


def event_summary(records: DataFrame) -> DataFrame:
    """One row: events, distinct types, aggregates and streams, the kinds of aggregates, and the longest stream."""
    streams = records.groupBy("original_stream_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("streams"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_stream"))
    distinct = lambda c, n: records.select(c).distinct().agg(F.count(c).alias(n))
    kinds = records.select("aggregate_type").distinct().agg(F.array_join(F.array_sort(F.collect_list("aggregate_type")), ",").alias("aggregate_types"))
    one = records.agg(F.count(F.lit(1)).alias("events"))
    for other in (distinct("event_type", "event_types"), distinct("aggregate_id", "aggregates"), kinds, streams):
        one = one.crossJoin(F.broadcast(other))  # one row each
    return one


def first_wins(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _once(value: Column, made) -> Column:
    """What ``made`` makes of a value, which is computed once however often that names it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _first_of_each(items: Column, key) -> Column:
    """Array elements without those whose key an earlier one has. A fold, as a lambda that named the array would make it anew for each element."""
    step = lambda acc, x: F.when(F.array_contains(acc["keys"], key(x)), acc).otherwise(F.struct(F.array_append(acc["keys"], key(x)).alias("keys"), F.array_append(acc["out"], x).alias("out")))
    start = lambda own: F.struct(F.array().cast("array<string>").alias("keys"), F.filter(own, lambda x: F.lit(False)).alias("out"))
    return _once(items, lambda own: F.aggregate(own, start(own), step, lambda acc: acc["out"]))


def entity_candidates(text: Column) -> Column:
    """array<struct<kind, value>>: DATE, AMOUNT, and ORG for acronyms and for title-case phrases that hold an organisation's word and no stop or heading word; each once in any case."""
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def parts(clean: Column) -> Column:
        found = lambda pattern: F.array_distinct(F.regexp_extract_all(clean, F.lit(f"(?U){pattern}"), 0))
        hinted = F.filter(found(PHRASE_PATTERN), lambda p: F.rlike(F.lower(p), F.lit("|".join(ORGANISATION))) & ~F.arrays_overlap(F.split(F.lower(p), " "), F.array(*map(F.lit, sorted({*STOP, *HEADINGS})))))
        return F.concat(*(tagged("DATE", found(p)) for p in DATE_PATTERNS), tagged("AMOUNT", found(AMOUNT_PATTERN)), tagged("ORG", found(ACRONYM_PATTERN)), tagged("ORG", hinted))

    found = _first_of_each(_once(X.squeeze(text), parts), lambda e: F.concat(e["kind"], F.lit(":"), F.lower(e["value"])))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,value:string>>"))


def classify_entity(value: Column) -> Column:
    """DATE, AMOUNT, LOCATION, ORG, PERSON or OTHER, by the first that fits."""
    v = X.squeeze(F.coalesce(value, F.lit("")))
    whole = lambda p: F.rlike(v, F.lit(f"^(?:{p})$"))
    some = lambda words: F.rlike(F.lower(v), F.lit("|".join(words)))
    dated = F.rlike(v, F.lit("|".join(f"(?:{p})" for p in DATE_PATTERNS)))
    return (
        F.when(v == "", "OTHER").when(dated, "DATE").when(F.rlike(v, F.lit(AMOUNT_PATTERN)), "AMOUNT").when(some(PLACES), "LOCATION").when(some(ORGANISATION), "ORG").when(whole(ACRONYM_PATTERN), "ORG")
        .when(whole(PERSON_PATTERN), "PERSON").when((F.size(F.split(v, " ")) > 1) & F.rlike(v, F.lit("^[A-Z]")), "ORG").otherwise("OTHER")
    )


def table_text(rows: Column) -> Column:
    """A table's rows (a variant: lists of cells, or objects) as text: cells joined by bars, fields as ``name: value``, rows by semicolons."""
    cell = lambda c: F.coalesce(F.try_variant_get(c, "$", "string"), F.when(F.is_variant_null(c), F.lit("")), F.to_json(c))
    fields = lambda r: F.transform(F.map_entries(F.try_variant_get(r, "$", "map<string,variant>")), lambda e: F.concat(e["key"], F.lit(": "), cell(e["value"])))
    row = lambda r: F.when(F.startswith(F.schema_of_variant(r), F.lit("OBJECT")), F.array_join(fields(r), " | ")).otherwise(F.coalesce(F.array_join(F.transform(F.try_variant_get(r, "$", "array<variant>"), cell), " | "), cell(r)))
    return X.squeeze(F.array_join(F.transform(F.try_variant_get(rows, "$", "array<variant>"), row), " ; "))


TEXT_LIST = "array<string>"
TABLE_LIST = "array<array<array<string>>>"


def _sources(page: Column, own: Column) -> Column:
    """array<struct<kind, page, text>> of a page's struct: its text, text blocks, table blocks, captions, tables; blanks left out."""
    one = lambda kind, texts: F.transform(F.coalesce(texts, F.array().cast(TEXT_LIST)), lambda t: F.struct(F.lit(kind).alias("kind"), page.alias("page"), X.squeeze(t).alias("text")))
    cells = lambda tables: F.transform(F.coalesce(tables, F.array().cast(TABLE_LIST)), lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, " | ")), " ; "))
    parts = F.concat(one("page_text", F.array(own["text"])), one("text_block", own["text_blocks"]), one("table_block", cells(own["table_blocks"])), one("figure_caption", own["captions"]), one("table", cells(own["tables"])))
    return F.filter(parts, lambda p: p["text"].isNotNull() & (p["text"] != ""))


def page_texts(df: DataFrame) -> DataFrame:
    """(doc_id, page, kind, text) of pages' own text, text blocks, table blocks, captions and tables (cells joined by bars, rows by semicolons); blanks left out."""
    own = F.struct("text", "text_blocks", "table_blocks", "captions", "tables")
    return df.select("doc_id", F.explode(_sources(F.col("page"), own)).alias("p")).select("doc_id", "p.page", "p.kind", "p.text")


PAGE = "struct<page_number:bigint,confidence:double,text:string,text_blocks:array<string>,table_blocks:array<array<array<string>>>,captions:array<string>,tables:array<array<array<string>>>>"
SOURCE = f"doc_id string, file_path string, file_name string, source_hash string, confidence double, strategy string, processing_sec double, modified double, pages array<{PAGE}>"


def extraction_records(df: DataFrame) -> DataFrame:
    """Extraction records (flatten.EXTRACTION) of documents (SOURCE): entities of all texts, a fact a page and text, and where there is no text one fact of the document's name. All within a row."""
    pages = F.coalesce("pages", F.array().cast(f"array<{PAGE}>"))
    texts = F.flatten(F.transform(pages, lambda p: _sources(F.coalesce(p["page_number"], F.lit(0)), p)))
    named = df.withColumn("_texts", _first_of_each(texts, lambda t: F.concat(t["page"].cast("string"), F.lit(":"), F.lower(t["text"]))))
    named = named.withColumn("_id", X.uuid5(F.concat_ws(":", F.lit("document"), "doc_id", "file_path")))
    found = entity_candidates(F.array_join(F.transform("_texts", lambda t: t["text"]), " "))
    uuid = lambda *parts: _once(X.uuid5_digest(F.concat_ws(":", *parts)), X.uuid5_of)
    entity = lambda e: F.struct(uuid(F.lit("entity"), "_id", e["kind"], F.lower(e["value"])).alias("entity_id"), e["value"].alias("name"), e["kind"].alias("type"), e["value"].alias("canonical_value"))
    named = named.withColumn("_entities", F.transform(found, entity))
    of_page = F.map_from_entries(_first_of_each(F.filter(F.transform(pages, lambda p: F.struct(F.coalesce(p["page_number"], F.lit(0)).alias("k"), p["confidence"].alias("v"))), lambda e: e["v"].isNotNull()), lambda e: e["k"].cast("string")))
    named = named.withColumn("_sure", of_page)
    # entities and confidences go with each text, as a lambda that named their columns could make them anew for each
    shared = F.struct(F.col("_entities").alias("entities"), F.col("_sure").alias("sure"))
    refs = lambda text, entities: _once(F.lower(text), lambda low: F.transform(F.filter(entities, lambda e: F.contains(low, F.lower(e["canonical_value"]))), lambda e: e["entity_id"]))
    fact = lambda t, own: F.struct(uuid(F.lit("fact"), "doc_id", t["page"].cast("string"), t["kind"], F.lower(t["text"])).alias("fact_id"), t["text"].alias("text"), refs(t["text"], own["entities"]).alias("entity_refs"), F.round(confidence(own["sure"][t["page"]], F.col("confidence")), 3).alias("confidence"), t["page"].cast("bigint").alias("page_ref"), X.shorten(t["text"]).alias("source_excerpt"))
    name = X.squeeze(first_of(F.col("file_name"), F.col("file_path"), F.col("doc_id"), default="document"))
    fallback = F.struct(X.uuid5(F.concat_ws(":", F.lit("fact"), "doc_id", F.lit("fallback"), F.lower(name))).alias("fact_id"), name.alias("text"), F.array().cast(TEXT_LIST).alias("entity_refs"), F.round(confidence(F.lit(None).cast("double"), F.col("confidence")), 3).alias("confidence"), F.lit(0).cast("bigint").alias("page_ref"), X.shorten(name).alias("source_excerpt"))
    facts = F.when(F.size("_texts") > 0, F.zip_with("_texts", F.array_repeat(shared, F.size("_texts")), fact)).otherwise(F.array(fallback))
    tokens = lambda c: F.aggregate(F.transform(c, lambda f: X.token_estimate(f["text"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    out = named.withColumn("extracted_facts", facts)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("file_path").alias("source_path"), "source_hash", "extracted_facts", F.col("_entities").alias("entities"), first_of(F.col("strategy"), default="unknown").alias("extraction_model"),
        F.bround(F.coalesce("processing_sec", F.lit(0.0)) * 1000).cast("bigint").alias("processing_time_ms"), F.struct(tokens("extracted_facts").alias("input"), tokens("extracted_facts").alias("output")).alias("token_count"), X.iso_utc(F.col("modified")).alias("extracted_at"),
    )


def confidence(page: Column, document: Column) -> Column:
    """The page's, else the document's, else 0; one that isn't within 0 and 1 is an error."""
    c = F.coalesce(page, document, F.lit(0.0))
    return F.when(c.between(0.0, 1.0), c).otherwise(F.raise_error(F.concat(F.lit("a confidence must be within 0 and 1, not "), c.cast("string"))).cast("double"))


def entity_facts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities with the facts of their document whose text holds them, in lower case."""
    hit = entities.join(facts, "doc_id").filter(F.contains(F.lower("text"), F.lower("canonical_value")))
    return hit.select("doc_id", "entity_id", "fact_id").distinct()


def graph_nodes(df: DataFrame, kinds: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a node_id: the kind that comes first in ``kinds``, then the shorter path, then the first."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("type")), F.lit(0))
    return first_wins(df.withColumn("_r", F.when(rank == 0, len(kinds) + 1).otherwise(rank)).withColumn("_l", F.length("path")), ["node_id"], ["_r", "_l", *order]).drop("_r", "_l")


def node_type(node_id: Column, name: Column, file_type: Column, dataset_type: Column, description: Column, path: Column) -> Column:
    """EXTERNAL, PIPELINE, FILE, MODEL or TABLE, by the first that fits; path: relative."""
    low = lambda c: F.lower(X.slashes(c))
    i, n, f, d, t = low(node_id), low(name), low(file_type), low(dataset_type), low(description)
    ends = lambda *e: F.rlike(path, F.lit(rf"\.(?:{'|'.join(e)})$"))
    macro = F.startswith(i, F.lit("macro:")) | F.rlike(n, F.lit("^(?:default__|macro_)")) | F.rlike(path, F.lit("(?:^|/)macros/"))
    return (
        F.when(F.contains(d, F.lit("external")) | F.contains(t, F.lit("external")), "EXTERNAL").when(macro, "PIPELINE").when(f.isin("yaml", "yml") | ends("yml", "yaml"), "FILE").when((d == "sql_file") | ends("sql"), "MODEL")
        .when(F.rlike(n, F.lit("^(?:stg|int|fct|dim|base)_")), "MODEL").when(F.rlike(F.concat(n, F.lit(" "), i), F.lit("relationship|source|column|metric|exposure")), "TABLE").when(path != "", "FILE").otherwise("TABLE")
    )


def path_language(path: Column) -> Column:
    """sql, yaml or unknown, by a file's ending."""
    p = F.lower(X.slashes(path))
    return F.when(F.endswith(p, F.lit(".sql")), "sql").when(F.rlike(p, F.lit(r"\.ya?ml$")), "yaml").otherwise("unknown")


def canonical_nodes(df: DataFrame, root: str | None = None, modified: Column | None = None) -> DataFrame:
    """node_id (``type::path``), type, label, path, language, purpose, last_modified and aliases of raw nodes: id, source_file, logical_name, description, file_type, dataset_type."""
    raw = {c: X.slashes(F.col(c)) for c in ("id", "source_file", "logical_name", "description")}
    path = X.relative(first_of(raw["source_file"], raw["id"], default=""), root)
    kind = node_type(F.col("id"), F.col("logical_name"), F.col("file_type"), F.col("dataset_type"), F.col("description"), path)
    aliases = F.filter(F.array(raw["id"], raw["source_file"], raw["logical_name"], path, F.substring_index(path, "/", -1), X.stem(path)), lambda a: a != "")
    return df.select(
        F.concat_ws("::", F.lower(kind), first_of(path, raw["id"], default="")).alias("node_id"), kind.alias("type"), first_of(raw["logical_name"], raw["description"], X.stem(path), raw["id"], default="unknown").alias("label"),
        path.alias("path"), path_language(path).alias("language"), first_of(raw["description"], raw["logical_name"], default="").alias("purpose"), (modified if modified is not None else F.lit(None).cast("string")).alias("last_modified"), F.array_distinct(aliases).alias("aliases"),
    )


def merged_nodes(*graphs: DataFrame, kinds: Sequence[str] = ("MODEL", "PIPELINE", "SERVICE", "TABLE", "FILE", "EXTERNAL")) -> DataFrame:
    """Canonical nodes of several graphs, each once: the earlier graph's, but for a kind that comes first or a shorter path."""
    out = graphs[0].withColumn("_graph", F.lit(0))
    for i, g in enumerate(graphs[1:], 1):
        out = out.unionByName(g.withColumn("_graph", F.lit(i)))
    return graph_nodes(out, kinds, ["_graph", "label", "path"]).drop("_graph")


def relationship(kind: Column) -> Column:
    """READS, WRITES, IMPORTS, CALLS, PRODUCES or CONSUMES of a transformation's kind; one that nobody knows reads."""
    return _looked_up(F.lower(X.slashes(kind)), {k: r for r, ks in RELATIONS.items() for k in ks}, F.lit("READS"))


def canonical_edges(edges: DataFrame, nodes: DataFrame, root: str | None = None) -> DataFrame:
    """(source, target, relationship, confidence) of raw edges edge_id, source_dataset, target_dataset, transformation_type, confidence; an end that is no node's alias is EXTERNAL."""
    named = edges.select("edge_id", X.relative(F.col("source_dataset"), root).alias("source"), X.relative(F.col("target_dataset"), root).alias("target"), relationship(F.col("transformation_type")).alias("relationship"), F.round(X.clamp(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)), 0.0, 1.0), 3).alias("confidence"))
    known = nodes.select(F.explode("aliases").alias("alias"), "node_id")
    out = resolved_edges(named, known, external="external")
    return out.select(F.col("source_node").alias("source"), F.col("target_node").alias("target"), "relationship", "confidence")


def common_root(paths: Sequence[str]) -> str | None:
    """The folder that all absolute paths have in common; None without any, or where they have none."""
    import posixpath

    absolute = [posixpath.normpath(p.replace("\\", "/")) for p in paths if p and p.replace("\\", "/").startswith("/")]
    return posixpath.commonpath(absolute) if absolute else None


def resolved_edges(edges: DataFrame, aliases: DataFrame, external: str = "EXTERNAL") -> DataFrame:
    """Edges whose ends are nodes' aliases, first candidate first; an end that nobody knows is EXTERNAL::end. aliases: alias, node_id."""
    names = aliases.groupBy("alias").agg(F.min("node_id").alias("node_id"))

    def end(df: DataFrame, name: str) -> DataFrame:
        e = F.col(name)
        base = F.substring_index(e, "/", -1)
        cands = F.array(e, F.lower(e), base, F.lower(base), X.stem(e))
        tried = df.select("edge_id", F.posexplode(cands).alias("prio", "alias")).join(names, "alias")
        best = tried.groupBy("edge_id").agg(F.min_by("node_id", "prio").alias(f"{name}_node"))
        return df.join(best, "edge_id", "left").withColumn(f"{name}_node", F.coalesce(f"{name}_node", F.concat(F.lit(f"{external}::"), e)))

    return end(end(edges, "source"), "target")


def sections(df: DataFrame, text: str) -> DataFrame:
    """(doc_id, position, heading, body): the second-level headings of Markdown and what is under them."""
    cuts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n## ")
    parts = F.slice(cuts, F.lit(2), F.size(cuts))
    return df.select("doc_id", F.posexplode(parts).alias("position", "s")).select("doc_id", "position", F.trim(F.substring_index("s", "\n", 1)).alias("heading"), F.trim(F.substr("s", F.length(F.substring_index("s", "\n", 1)) + 2)).alias("body"))


def verdicts(df: DataFrame, text: str) -> DataFrame:
    """Per report: the number of criteria with a score, their mean, spread, the verdict (its own, or by the mean: 3.5 PASS, 2.5 CONDITIONAL) and confidence."""
    scores = sections(df, text).select("doc_id", "heading", F.nullif(F.regexp_extract("body", r"(?im)^score:\s*([0-9.]+)", 1), F.lit("")).try_cast("double").alias("score")).filter("score is not null")
    agg = scores.groupBy("doc_id").agg(F.count(F.lit(1)).alias("criteria"), F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"))
    own = df.select("doc_id", F.nullif(F.upper(F.regexp_extract(text, r"(?im)^verdict:\s*(\w+)", 1)), F.lit("")).alias("said"))
    by_mean = F.when(F.col("mean") >= 3.5, "PASS").when(F.col("mean") >= 2.5, "CONDITIONAL").otherwise("BLOCK")
    sure = X.clamp(0.70 + 0.06 * F.col("mean") - 0.01 * F.col("spread"), 0.5, 0.99)
    return agg.join(own, "doc_id").select("doc_id", "criteria", F.round("mean", 4).alias("overall_score"), F.coalesce("said", by_mean).alias("overall_verdict"), F.round(sure, 4).alias("confidence"))


_FIELD = r"(?im)\*\*(?:{names}):\*\*\s*{value}"
_EVIDENCE = (r"(?im)^\s*-\s*Cited Evidence:\s*(.+?)\s*$", r"(?im)^\s*-\s*Cited:\s*(.+?)\s*$", r"(?im)^\s*\*\*File-level Remediation Targets:\*\*\s*(.+?)\s*$")


def _field(text: Column, names: str, value: str) -> Column:
    """A bold field's value in Markdown; null where there is none."""
    return F.nullif(F.regexp_extract(text, _FIELD.format(names=names, value=value), 1), F.lit(""))


def criteria(text: Column) -> Column:
    """array<struct<criterion, score, evidence, notes>>: the scored sections of an audit report, each under a heading ``### Criterion: name`` (or Dimension)."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(text, r"(?im)^[^\S\n]*###[^\S\n]+(?:Dimension|Criterion)[^\S\n]*:[^\S\n]*([a-z0-9_\-]+)[^\S\n]*$", f"{mark}$1{mark}"), mark)
    paired = lambda cut_up: F.transform(F.sequence(F.lit(1), F.size(cut_up) - 1, F.lit(2)), lambda i: F.struct(F.get(cut_up, i).alias("criterion"), F.regexp_replace(F.coalesce(F.get(cut_up, i + 1), F.lit("")), r"(?s)\n### .*$", "").alias("body")))
    bodies = _once(pieces, lambda cut_up: F.when(F.size(cut_up) > 2, paired(cut_up)).otherwise(F.array().cast("array<struct<criterion:string,body:string>>")))
    split_up = lambda s: F.filter(F.transform(F.split(s, r"\s*[,;]\s*"), X.squeeze), lambda x: x != "")
    evidence = lambda b: F.array_distinct(F.flatten(F.concat(*[F.transform(F.regexp_extract_all(b, F.lit(p), 1), split_up) for p in _EVIDENCE])))
    note = lambda b, names: F.nullif(X.squeeze(F.regexp_extract(b, rf"(?is)\*\*{names}:\*\*\s*(.+?)(?:\n\s*\n|\n###\s+|\z)", 1)), F.lit(""))
    one = lambda s: F.struct(
        s["criterion"].alias("criterion"), F.nullif(F.regexp_extract(s["body"], r"(?i)\*\*Final Score:\*\*\s*(\d+(?:\.\d+)?)/5", 1), F.lit("")).try_cast("double").alias("score"),
        _once(evidence(s["body"]), lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(F.concat(F.lit("section "), s["criterion"])))).alias("evidence"),
        F.coalesce(note(s["body"], "Dissent Summary"), note(s["body"], "Deterministic Resolution"), F.concat(F.lit("from section "), s["criterion"])).alias("notes"),
    )
    return F.filter(F.transform(bodies, one), lambda s: s["score"].isNotNull())


def verdict_records(df: DataFrame, text: str, path: str, rubric: tuple[str, str] | None = None, now: str = "") -> DataFrame:
    """Verdict records of audit reports: target_ref, rubric_id and version, scores (map), overall score and verdict, confidence, evaluated_at; what a report doesn't say comes from its scores, its path, or ``now``."""
    t = F.col(text)
    own = df.withColumn("_scores", criteria(t))
    scores = F.transform("_scores", lambda s: s["score"])
    own = own.withColumns({"_n": F.size(scores), "_mean": F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(scores), F.lit(1)), "_spread": F.array_max(scores) - F.array_min(scores)})
    overall = F.coalesce(_field(t, "Overall Score", r"([0-9]+(?:\.[0-9]+)?)").try_cast("double"), F.when(F.col("_n") > 0, F.round("_mean", 2)), F.lit(0.0))
    own = own.withColumn("overall_score", F.round(overall, 2))
    by_score = F.when(F.col("overall_score") >= 3.5, "PASS").when(F.col("overall_score") >= 2.5, "CONDITIONAL").otherwise("BLOCK")
    sure = F.when(F.col("_n") == 0, 0.5).otherwise(F.round(X.clamp(0.70 + 0.06 * F.col("overall_score") - 0.01 * F.col("_spread"), 0.5, 0.99), 2))
    said = _field(t, "Confidence", r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")
    names = F.array_join(F.transform("_scores", lambda s: s["criterion"]), "\n")
    rubric_id, version = (F.lit(rubric[0]), F.lit(rubric[1])) if rubric else (F.sha2(F.when(names != "", names).otherwise(t), 256), F.lit("1.0.0"))
    target = F.coalesce(F.nullif(X.squeeze(_field(t, "Repository|Target|Repository URL|Target Ref", r"(.+)$")), F.lit("")), X.stem(F.col(path)))
    return own.select(
        X.uuid5(F.concat_ws(":", target, rubric_id, version, F.col(path))).alias("verdict_id"), target.alias("target_ref"), rubric_id.alias("rubric_id"), version.alias("rubric_version"),
        F.map_from_entries(F.transform(_first_of_each(F.reverse("_scores"), lambda s: s["criterion"]), lambda s: F.struct(s["criterion"].alias("k"), F.struct(s["score"].alias("score"), s["evidence"].alias("evidence"), s["notes"].alias("notes")).alias("v")))).alias("scores"),
        F.coalesce(F.upper(_field(t, "Overall Verdict|Audit Status|Verdict", r"([A-Z_]+)")), by_score).alias("overall_verdict"), "overall_score",
        F.coalesce(F.when(said.isNotNull(), X.clamp(said, 0.0, 1.0)), sure).alias("confidence"), F.coalesce(F.nullif(X.squeeze(_field(t, "Evaluated At|Generated At", r"(.+)$")), F.lit("")), F.lit(now)).alias("evaluated_at"),
    )
