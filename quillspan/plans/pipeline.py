"""The whole runs: parse only, optimize only, the full run from files to linked notes, relinking, status."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import concept_phrases, strip, tags_of, transcript
from quillspan.functions.unicode import kebab_case, link_target_keys, topic
from quillspan.operators import archive, chunks, layout, linking, manifest, notes, passes
from quillspan.plans.blocks import rank_in_groups
from quillspan.session import cut
from quillspan.sources import documents, files, sinks

#: Place of a built index note in its conversation: behind all others.
INDEX_NO = 2**62
BANNER = "> ⚠ This source PDF was %d%% image-only. Notes below reflect\n> only the extractable text. Visual content (diagrams, photos,\n> scanned pages) was not captured."


@dataclass
class Settings:
    """Settings of a run; ``run_date`` is given, so that a run can be repeated with the same result."""

    run_date: str = "1970-01-01"
    force: bool = False
    dry_run: bool = False
    max_links: int = linking.MAX_LINKS
    window: dict = field(default_factory=dict)
    complete: object = notes.first_line_writer
    clean: object = None
    #: Folders of the saved manifest and of archived inputs, both only used where they are given, and (domain, code) of
    #: archive names.
    manifest_dir: str | None = None
    archive_dir: str | None = None
    codes: list = field(default_factory=list)

    @classmethod
    def from_config(cls, path: str, **over) -> Settings:
        known = {k: v for k, v in files.read_config(path).items() if k in cls.__dataclass_fields__}
        return cls(**known | over)


def inputs(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (file_id, name, content, content_sha, error, image_only_pct): office documents and PDFs as
    text; a file that cannot be read has no content but its error, and a PDF mostly of images has their percentage."""
    raw = files.list_inputs(spark, path).withColumn("content_sha", F.sha2("content", 256))
    ids = raw.select("path", F.xxhash64("path").alias("file_id"))
    named = raw.join(ids, "path").select("file_id", F.substring_index("path", "/", -1).alias("name"), "content", "content_sha")
    none = {"error": F.lit(None).cast("string"), "image_only_pct": F.lit(None).cast("int")}
    plain = named.where(~F.lower("name").rlike(r"\.(docx|pdf)$")).select("file_id", "name", files.decode("content").alias("content"), "content_sha").withColumns(none)
    shas = named.select("file_id", "content_sha")
    docx = documents.docx_files(named.where(F.lower("name").endswith(".docx"))).join(shas, "file_id").withColumn("image_only_pct", none["image_only_pct"])
    pdf = named.where(F.lower("name").endswith(".pdf"))
    pages = cut(documents.pdf_pages(pdf.select(F.col("file_id").cast("string").alias("name"), "content")))
    read = pages.where("error IS NULL")
    text = documents.joined_pages(layout.strip_page_edges(read.select("file", "page_no", "lines", "tables"))).withColumnRenamed("name", "file")
    heavy = layout.page_stats(read).where("image_heavy").select("file", "image_only_pct")
    errors = pages.where("error IS NOT NULL").select("file", "error")
    told = pdf.select(F.col("file_id").cast("string").alias("file"), "file_id", "name", "content_sha").join(text, "file", "left").join(errors, "file", "left").join(heavy, "file", "left").drop("file")
    return plain.unionByName(docx).unionByName(told)


def failed(every: DataFrame) -> DataFrame:
    """The inputs that could not be read, with their errors."""
    return every.where("error IS NOT NULL").select("file_id", "name", "content_sha", "error")


def conversations(spark: SparkSession, parsed: DataFrame) -> DataFrame:
    """Parsed turns with one text key per conversation."""
    key = F.concat_ws("/", F.col("file_id").cast("string"), F.col("conv_no").cast("string"))
    return parsed.select(key.alias("conv_id"), "file_id", "session", F.col("turn").cast("int").alias("turn"), "role", "content", "timestamp")


def parse_only(spark: SparkSession, path: str) -> DataFrame:
    """Turns as JSON, one per row; behind them a row (file_id, name, content_sha, error) for each unreadable file."""
    every = cut(inputs(spark, path))
    return sinks.as_json(files.parse_files(every.select("file_id", "name", "content"))).unionByName(sinks.as_json(failed(every)))


def optimize_only(spark: SparkSession, path: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned turns, the report and the unreadable files."""
    s = settings or Settings()
    every = cut(inputs(spark, path))
    return *passes.optimize(conversations(spark, files.parse_files(every.select("file_id", "name", "content"))), s.clean), failed(every)


def link_rows(ns: DataFrame, session: str, new: bool) -> DataFrame:
    """Notes (id, path, title, type, tags, related, cross_links, body) as rows for linking."""
    return ns.select(
        "id", "path", "title", F.lower("title").alias("title_key"), kebab_case("title").alias("stem"), kebab_case("title").alias("slug"), tags_of("tags").alias("tags"),
        concept_phrases("title").alias("phrases"), F.lower("body").alias("body_lower"), link_target_keys("body", "related", "cross_links").alias("link_keys"),
        F.col(session).alias("session"), F.lower("type").alias("note_type"), F.lit(new).alias("new"),
    )


def settled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, index notes) of parsed notes with ``n_chunks`` of their conversation: notes of several chunks are merged;
    an index note is the last one of a single chunk, else it is built over the notes that stay."""
    is_index, many = notes.is_index("title", "type"), F.col("n_chunks") > 1
    atoms, indexes = found.where(~is_index), found.where(is_index)
    merged, _ = notes.merge(atoms.where(many), "conv_id", "note_no")
    atoms = cut(merged.unionByName(atoms.where(~many)))
    last = indexes.where(~many).groupBy("conv_id").agg(F.max("note_no").alias("note_no"))
    own = indexes.join(last, ["conv_id", "note_no"], "left_semi")
    value = F.col("extra")["detected_client"]
    client = strip(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
    told = indexes.where((client != "") & ~value.isin("false", "0", "[]", "{}")).groupBy("conv_id").agg(F.min_by(client, "note_no").alias("client"))
    plain = atoms.withColumns({"type": F.coalesce("type", F.lit("atomic-note")), "source_domain": F.coalesce("source_domain", F.lit("general"))})
    built = notes.index_note(plain.join(last, "conv_id", "left_anti"), "conv_id", "note_no")
    built = built.join(found.groupBy("conv_id").agg(F.first("file_id").alias("file_id")), "conv_id").join(told, "conv_id", "left")
    extra = F.when(F.col("client").isNotNull(), F.create_map(F.lit("detected_client"), F.regexp_replace(F.to_json(F.array("client")), r"^\[|\]$", "")))
    none = F.array().cast("array<string>")
    built = built.select(
        "conv_id", "file_id", F.lit(INDEX_NO).alias("note_no"), "title", F.lit("moc").alias("type"), F.lit("general").alias("source_domain"), F.lit("high").alias("confidence"),
        F.lit("active").alias("status"), F.array(F.lit("moc"), F.lit("index")).alias("tags"), none.alias("related"), none.alias("cross_links"), extra.alias("extra"), "body",
    )
    return atoms, own.select(*built.columns).unionByName(built)


def stamped(ns: DataFrame, pct: DataFrame, run_date: str) -> DataFrame:
    """Notes normalised, with provenance, an id, and the warning of PDFs mostly of images (file_id, image_only_pct)."""
    warning = F.format_string('"Source PDF was %d%% image-only — visual content not captured"', "image_only_pct")
    others = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, _: k != "extraction_warning")
    image = F.col("image_only_pct").isNotNull()
    ns = ns.join(pct, "file_id", "left").withColumn("extra", F.when(image, F.map_concat(others, F.create_map(F.lit("extraction_warning"), warning))).otherwise(F.col("extra")))
    if "is_index" in ns.columns:
        quote = F.format_string(BANNER, "image_only_pct")
        head, rest = F.regexp_extract("body", r"(?s)^([^\n]*)\n*(.*)$", 1), F.regexp_extract("body", r"(?s)^([^\n]*)\n*(.*)$", 2)
        banner = F.when(F.ltrim(head).startswith("#"), F.concat_ws("\n\n", head, quote, rest)).otherwise(F.concat_ws("\n\n", quote, "body"))
        ns = ns.withColumn("body", F.when(image, banner).otherwise(F.col("body"))).drop("is_index")
    prov = {"source_session": F.col("conv_id"), "source_file": F.col("file_id").cast("string"), "created": F.lit(run_date)}
    ns = notes.normalise(ns.drop("image_only_pct"), prov)
    return cut(ns.withColumn("id", F.xxhash64("conv_id", "note_no")).withColumn("path", F.col("title")))


def full(spark: SparkSession, path: str, vault: str, out: str, known: DataFrame | None = None, settings: Settings | None = None) -> dict[str, DataFrame]:
    """From files to written, linked notes.

    Notes are linked to those of the vault as it is before the run (one join for all conversations); turns go by
    conversation until there are notes, then everything goes by note. Gives the tables of the run."""
    s = settings or Settings()
    version = 0
    if s.manifest_dir:
        saved, version = sinks.latest_manifest(spark, s.manifest_dir)
        known = saved if known is None else known
    every = cut(inputs(spark, path))
    fresh = every if known is None else manifest.pending(every, known, s.force)
    parsed = cut(files.parse_files(fresh.select("file_id", "name", "content")))
    turns, report = passes.optimize(conversations(spark, parsed), s.clean)
    turns = cut(turns)
    ranked = rank_in_groups(turns, ["conv_id"], "turn", "pos", first=0)
    plan = chunks.plan(ranked.select("conv_id", F.col("pos").alias("turn"), "content"), **s.window)
    parts = chunks.members(plan).join(ranked, ["conv_id", "pos"]).groupBy("conv_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "content", "timestamp"))).alias("ts"), F.first("file_id").alias("file_id")
    )
    asked = parts.select("conv_id", "chunk_no", "file_id", transcript("ts").alias("user"), F.lit("").alias("system"))
    raw = cut(notes.extract(asked, s.complete, "system", "user"))
    found = notes.parse(notes.blocks(raw.select("conv_id", "chunk_no", "file_id", "text"), "text"))
    found = found.withColumn("note_no", F.shiftleft(F.col("chunk_no").cast("bigint"), 31) + F.col("block_no"))
    found = cut(found.join(parts.groupBy("conv_id").agg(F.count("*").alias("n_chunks")), "conv_id"))
    kept, index = settled(found)
    pct = fresh.where("image_only_pct IS NOT NULL").select("file_id", "image_only_pct")
    kept, index = (stamped(x, pct, s.run_date) for x in (kept, index.withColumn("is_index", F.lit(True))))
    old = cut(files.vault_index(files.read_vault(spark, vault)).withColumn("id", F.xxhash64("path")).withColumn("new", F.lit(False)))
    mine = cut(link_rows(kept, "source_session", True))
    forward = cut(linking.forward_links(linking.top(linking.candidates(mine, old), old, s.max_links), old))
    back = linking.back_links(forward, mine).join(old.select(F.col("id").alias("tgt"), "path"), "tgt")
    links = forward.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "tgt_title", "reason"))).alias("fw")).withColumnRenamed("src", "id")
    from quillspan.functions.text import append_footer, bullet

    linked = kept.join(links, "id", "left")
    footer = append_footer("body", F.transform("fw", lambda x: bullet(x["tgt_title"], x["reason"])))
    own = F.transform("fw", lambda x: F.concat(F.lit("[["), x["tgt_title"], F.lit("]]")))
    linked = linked.withColumn("body", F.when(F.col("fw").isNotNull(), footer).otherwise(F.col("body"))).withColumn(
        "cross_links", F.when(F.col("fw").isNotNull(), F.concat(F.coalesce("cross_links", F.array().cast("array<string>")), own)).otherwise(F.col("cross_links"))
    )
    named = notes.names(linked.withColumn("domain", F.col("source_domain")), "domain", ["conv_id", "note_no"])
    fields = ["type", "source_session", "source_file", "source_domain", "created", "confidence", "tags", "related", "status", "cross_links"]
    written = cut(sinks.write_notes(named.withColumn("document", notes.render(named, fields)).select("domain", "file_name", "document"), out, s.dry_run))
    # after the notes, so that those take their names first; index notes are neither linked nor link targets
    index = notes.names(index.withColumn("domain", F.col("source_domain")), "domain", ["conv_id", "note_no"])
    index_written = cut(sinks.write_notes(index.withColumn("document", notes.render(index, fields)).select("domain", "file_name", "document"), out, s.dry_run))
    changed = cut(sinks.write_back_links(back, dry_run=s.dry_run))
    linked_by = ["id", "title", "slug", "body", "related", "cross_links"]
    dangling = linking.dangling(named.select(*linked_by).unionByName(index.select(*linked_by)))
    # what could not be read is not done: the next run takes it again
    done = every.where("error IS NULL").join(fresh.select("file_id").distinct(), "file_id", "left_semi")
    counts = named.select("file_id").unionByName(index.select("file_id")).groupBy("file_id").agg(F.count("*").cast("int").alias("notes_generated"))
    entries = done.join(counts, "file_id", "left").select("content_sha", F.col("name").alias("input_file"), F.lit(s.run_date).alias("processed_date"), F.coalesce("notes_generated", F.lit(0)).alias("notes_generated"))
    tables = {"report": report, "notes": named, "written": written, "index": index, "index_written": index_written, "back_links": changed, "dangling": dangling, "usage": raw.select("conv_id", "chunk_no", "input_tokens", "output_tokens", "error"), "failed": failed(fresh)}
    if s.archive_dir:
        tables["archived"] = archived(spark, path, done, named, s)
        entries = entries.join(done.join(tables["archived"], "file_id").select("content_sha", "archived_as"), "content_sha", "left")
    tables["manifest"] = entries = cut(entries.dropDuplicates(["content_sha"]))
    if s.manifest_dir and not s.dry_run:
        sinks.write_manifest(entries if known is None else manifest.upsert(known, entries), s.manifest_dir, version + 1)
    return tables


def archived(spark: SparkSession, path: str, done: DataFrame, ns: DataFrame, s: Settings) -> DataFrame:
    """(file_id, archived_as): the inputs of a run moved to the archive under names by day, number, the domain of most of
    their notes and topic; with ``dry_run`` only the names. One small row a file passes the driver."""
    at = files.list_inputs(spark, path).select("path", F.xxhash64("path").alias("file_id"))
    domain = archive.majority(ns, "file_id", "source_domain", "note_no")
    rows = done.select("file_id", "name").join(at, "file_id").join(domain, "file_id", "left").withColumn("day", F.lit(s.run_date))
    rows = archive.lookup(archive.sequences(rows, "day", ["name", "file_id"]), "source_domain", [tuple(x) for x in s.codes], "code")
    suffix = F.regexp_extract("name", r"(\.[^./]+)$", 1)
    stem = F.regexp_replace("name", r"\.[^./]+$", "")
    name = archive.archive_name(F.col("day"), F.col("seq"), F.col("code"), F.lit(archive.UNKNOWN), F.lit("DOC"), topic(stem), suffix)
    planned = rows.select("file_id", "path", name.alias("archived_as")).orderBy("archived_as")
    if s.dry_run:
        return planned.select("file_id", "archived_as")
    moves = [(r.file_id, sinks.local(r.path), f"{s.archive_dir}/{r.archived_as}") for r in planned.toLocalIterator()]
    places = sinks.archive([(a, b) for _, a, b in moves])
    return spark.createDataFrame([(i, p) for (i, _, _), p in zip(moves, places)], "file_id bigint, archived_as string")


def relink(spark: SparkSession, vault: str, settings: Settings | None = None) -> DataFrame:
    """Links the notes of a vault with each other and writes both sides of each pair; gives one row per file."""
    s = settings or Settings()
    rows = cut(files.vault_index(files.read_vault(spark, vault)).withColumn("id", F.xxhash64("path")).withColumn("new", F.lit(False)))
    pairs = cut(linking.candidates(rows, rows))
    linked = linking.relink(pairs, rows, s.max_links)
    why = pairs.select(F.least("src", "tgt").alias("note_a"), F.greatest("src", "tgt").alias("note_b"), "reason").groupBy("note_a", "note_b").agg(F.max("reason").alias("reason"))
    both = linked.join(why, ["note_a", "note_b"])
    sides = both.select(F.col("note_a").alias("tgt"), F.col("note_b").alias("src"), "reason").unionByName(both.select(F.col("note_b").alias("tgt"), F.col("note_a").alias("src"), "reason"))
    back = linking.back_links(sides, rows).join(rows.select(F.col("id").alias("tgt"), "path"), "tgt")
    return cut(sinks.write_back_links(back, dry_run=s.dry_run))
