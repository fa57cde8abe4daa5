"""Batches of documents: names of outputs, manifests, joins by path, summaries and combined documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..formats import base_name, extension
from ..functions.text import collection_frontmatter, estimate_tokens, savings_percent, slugify, strip

SCHEMA = "path string, status string, output string, markdown string, tokens bigint, source_tokens bigint, unread_images int, error string"


def normal_path(path: Column) -> Column:
    """Slashes single, no trailing one, ``.`` segments gone."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(\.?/)+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"(/\.)?/?\z", ""))


def output_name(path: Column) -> Column:
    """The source's path with its suffix replaced by .md."""
    ext = extension(path)
    return F.concat(F.substring(path, F.lit(1), (F.length(path) - F.length(ext)).cast("int")), F.lit(".md"))


#: A number as naming writes it, at the end of a name without its suffix.
NUMBERED = r" \(([1-9]\d{0,8})\)\z"
#: Numbers of a name in one stretch of a ranking.
STRETCH_BITS = 16


def _parts(stem: str) -> tuple[Column, Column]:
    """A numbered name's own name and number (null if it has none)."""
    n = F.regexp_extract(stem, NUMBERED, 1)
    return F.regexp_replace(stem, NUMBERED, ""), F.when(n != "", n.cast("long"))


def _runs(numbers: DataFrame) -> DataFrame:
    """(stem, part, shift, len): the runs of each stem's numbers n, by stretches, so that no task ranks all numbers of a stem.

    A run's numbers are their ranks in their stretch plus ``shift``; repeated numbers count once.
    """
    rank = F.dense_rank().over(Window.partitionBy("stem", "part").orderBy("n"))
    rows = numbers.withColumn("part", F.shiftright("n", STRETCH_BITS)).withColumn("shift", F.col("n") - rank)
    return rows.groupBy("stem", "part", "shift").agg((F.max("n") - F.min("n") + 1).alias("len"))


def _before(by: str = "part") -> Column:
    """How many of a stem's numbers lie in earlier stretches than a run's."""
    return F.coalesce(F.sum("len").over(Window.partitionBy("stem").orderBy(by).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbers_of(stems: DataFrame) -> DataFrame:
    """(stem, n) of names that are numbered forms of another."""
    own, n = _parts("stem")
    return stems.select(own.alias("stem"), n.alias("n")).filter("n IS NOT NULL")


def _bare_numbers(bare: DataFrame, taken: DataFrame) -> DataFrame:
    """(stem, n) for files without a suffix: they come before all others of their name, and before its numbered forms.

    Such a file keeps its name, or takes the first number that was free from the start; with that it can take the name of the next
    such file, and so on.  Whether a file's name is taken follows from the files whose names it extends, at most as many as it has numbers.
    """
    stems = bare.select("stem")
    # the run of taken numbers from 1
    run = _runs(_numbers_of(taken)).withColumn("before", _before()).filter("shift = before").groupBy("stem").agg(F.sum("len").alias("run"))
    nodes = stems.join(run, "stem", "left").join(taken.withColumn("is_taken", F.lit(True)), "stem", "left")
    nodes = nodes.select("stem", (F.coalesce("run", F.lit(0)) + 1).alias("first"), F.coalesce("is_taken", F.lit(False)).alias("is_taken"))
    tail = F.regexp_extract("stem", r"((?: \([1-9]\d{0,8}\))+)\z", 1)
    groups = F.regexp_extract_all(tail, F.lit(r" \([1-9]\d{0,8}\)"), F.lit(0))
    base = F.substring("stem", F.lit(1), (F.length("stem") - F.length(tail)).cast("int"))
    above = F.transform(F.sequence(F.lit(0), F.size(groups)), lambda i: F.concat(base, F.array_join(F.slice(groups, F.lit(1), i), "")))
    chain = stems.select(F.col("stem").alias("of"), F.posexplode(above).alias("pos", "stem")).join(nodes, "stem")
    chain = chain.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("pos", "stem", "first", "is_taken"))).alias("xs"))
    state = F.struct(F.lit(False).alias("moved"), F.lit("").alias("to"))

    def step(a: Column, x: Column) -> Column:
        moved = x["is_taken"] | (a["moved"] & (a["to"] == x["stem"]))
        return F.struct(moved.alias("moved"), F.concat(x["stem"], F.lit(" ("), x["first"].cast("string"), F.lit(")")).alias("to"))

    moved = F.aggregate("xs", state, step)["moved"]
    return chain.select(F.col("of").alias("stem"), F.when(moved, F.element_at("xs", -1)["first"]).otherwise(F.lit(0).cast("long")).alias("n"))


def unique_outputs(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Adds output to (path): in order of path, each source takes the first free of ``name.md``, ``name (1).md``, ``name (2).md``, ...

    taken: (output) names that exist.  Naming doesn't depend on which task comes first; a path that is listed
    twice has one output.  The i-th source of a name takes its i-th free number.  As a blank comes before a dot,
    sources of ``name (1)`` come before those of ``name``: a number is free if neither a name that exists nor
    another source's own name has it.  Free numbers are counted by the runs of others between them, so nothing is
    settled one after another.
    """
    src = files.select("path").distinct().withColumn("stem", F.regexp_replace(output_name(F.col("path")), r"\.md\z", ""))
    gone, moved = _numbers_of(src.select("stem")), None
    if taken is not None:
        taken = taken.filter(F.col("output").endswith(".md")).select(F.expr("left(output, length(output) - 3)").alias("stem")).distinct()
        zero = lambda df, stem: df.select(stem, F.lit(0).cast("long").alias("n"))
        gone = gone.union(_numbers_of(taken)).union(zero(taken, "stem"))
        bare = extension(F.col("path")) == ""
        if src.filter(bare).join(taken, "stem", "left_semi").head(1):
            numbers = _bare_numbers(src.filter(bare), taken)
            moved = src.filter(bare).join(numbers, "stem").filter("n > 0").select("path", "stem", "n")
            own = F.struct("stem", "n")
            further = F.struct(F.concat("stem", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("stem"), F.lit(0).cast("long").alias("n"))
            gone = gone.union(numbers.select(F.inline(F.when(F.col("n") > 0, F.array(own, further)).otherwise(F.array(own)))))
            src = src.filter(~bare)
    none = lambda kind: F.lit(None).cast(kind)
    rows = src.select("stem", "path", none("long").alias("part"), none("long").alias("shift"), F.lit(0).cast("long").alias("len"))
    rows = rows.union(_runs(gone).select("stem", none("string"), "part", "shift", "len"))
    # how many free numbers come before a source's, and before a run
    order = Window.partitionBy("stem").orderBy(F.col("path").asc_nulls_last())
    rows = rows.withColumn("at", F.when(F.col("path").isNotNull(), F.row_number().over(order) - 1).otherwise(F.col("shift") - _before() + 1))
    upto = Window.partitionBy("stem").orderBy("at", F.col("path").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("n", F.col("at") + F.sum("len").over(upto)).filter("path IS NOT NULL AND n > 0").select("path", "stem", "n")
    both = both if moved is None else both.union(moved)
    renamed = both.select(F.col("path").alias("path_"), F.concat("stem", F.lit(" ("), F.col("n").cast("string"), F.lit(").md")).alias("output_"))
    rows = files.join(renamed, F.col("path") == F.col("path_"), "left")
    return rows.withColumn("output", F.coalesce("output_", output_name(F.col("path")))).drop("path_", "output_")


def named_outputs(files: DataFrame, manifest: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Adds output to (path): what an earlier run's manifest (source, output) says; all other files are named anew, around those names."""
    if manifest is None:
        return unique_outputs(files, taken)
    # paths, not whole rows, are looked up twice
    paths = apply_manifest(files.select("path").distinct().withColumn("output", F.lit(None).cast("string")), manifest)
    kept = paths.filter("output IS NOT NULL")
    used = kept.select("output") if taken is None else kept.select("output").union(taken.select("output"))
    names = kept.union(unique_outputs(paths.filter("output IS NULL").select("path"), used)).select(F.col("path").alias("path_"), "output")
    return files.join(names, F.col("path") == F.col("path_")).drop("path_")


def apply_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outputs of an earlier run (source, output) take the place of computed ones."""
    earlier = manifest.filter(F.lower("output").endswith(".md")).groupBy(normal_path(F.col("source")).alias("np_")).agg(F.min("output").alias("earlier_"))
    rows = files.withColumn("np_", normal_path(F.col("path"))).join(earlier, "np_", "left")
    return rows.withColumn("output", F.coalesce("earlier_", "output")).drop("np_", "earlier_")


def common_folder(folders: str = "folder") -> Column:
    """An aggregate: the longest path that all folders (absolute, slashes single) lie in; null for none.  It is what the least and the greatest have in common, segment by segment."""
    parts = F.split(F.regexp_replace(folders, r"/+\z", ""), "/", -1)
    low, high = F.min(parts), F.max(parts)
    same = F.transform(low, lambda p, i: F.get(high, i).eqNullSafe(p))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(low))
    path = F.array_join(F.slice(low, F.lit(1), n.cast("int")), "/")
    return F.when(n > 0, F.when(path == "", "/").otherwise(path))


def exclude(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """files without those whose path is in excluded (path)."""
    gone = excluded.select(normal_path(F.col("path")).alias("np_")).distinct()
    return files.withColumn("np_", normal_path(F.col("path"))).join(gone, "np_", "left_anti").drop("np_")


def mark_cancelled(results: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Files that the user cancelled are skipped, whatever came of them."""
    gone = cancelled.select(normal_path(F.col("path")).alias("np_")).distinct().withColumn("cut_", F.lit(True))
    rows = results.withColumn("np_", normal_path(F.col("path"))).join(gone, "np_", "left")
    return rows.withColumn("status", F.when(F.col("cut_"), "skipped").otherwise(F.col("status"))).drop("np_", "cut_")


def owners(files: DataFrame, items: DataFrame) -> DataFrame:
    """The first item (item_seq, item) that is each file (path) or a folder above it, null where none is.

    Every file is looked up by its own path and all folders above it, so this is an
    equi-join and never compares all files with all items.
    """
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/", -1))), lambda n: F.array_join(F.slice(F.split("path", "/", -1), F.lit(1), n), "/"))
    keys = files.select("path").distinct().select("path", F.explode(folders).alias("key_"))
    found = keys.join(items.select(F.regexp_replace("item", "/+$", "").alias("key_"), "item_seq", "item"), "key_")
    best = found.groupBy("path").agg(F.min(F.struct("item_seq", "item")).alias("o_"))
    return files.join(best, "path", "left").withColumn("item_seq", F.col("o_.item_seq")).withColumn("item", F.col("o_.item")).drop("o_")


def summary_columns(total: bool = False) -> list[Column]:
    done, known = F.col("status") == "done", (F.col("status") == "done") & (F.col("source_tokens") > 0)
    src, out = F.coalesce(F.sum(F.when(known, F.col("source_tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(known, F.col("tokens"))), F.lit(0))
    cols = [
        F.count_if(done).alias("converted"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("tokens"))), F.lit(0)).alias("tokens"),
        src.alias("src_tokens"),
        out.alias("out_comparable"),
        F.greatest(F.lit(0), src - out).alias("saved_vs_raw"),
    ]
    return [c.cast("long").alias(n) for c, n in zip(cols, ["converted", "failed", "skipped", "tokens", "src_tokens", "out_comparable", "saved_vs_raw"])]


def batch_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts and token sums of (status, tokens, source_tokens); files without a baseline count on neither side.  ``by``: a rollup."""
    out = (results.rollup(*by) if by else results).agg(*summary_columns())
    return out.withColumn("percent", savings_percent(F.col("src_tokens"), F.col("out_comparable")))


def combined(docs: DataFrame, stamp: str | None = None, toc: bool = True) -> DataFrame:
    """(collection, name, body) to one Markdown document for each collection, its parts in order of name."""
    parts = docs.groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("name", "body"))).alias("p_"))
    title = F.concat(F.lit("# "), F.col("collection"), F.lit("\n\n"))
    entries = F.array_join(F.transform("p_", lambda p: F.concat(F.lit("- ["), p["name"], F.lit("](#"), slugify(p["name"]), F.lit(")\n"))), "")
    bodies = F.array_join(F.transform("p_", lambda p: F.concat(F.lit("\n\n---\n## "), p["name"], F.lit("\n\n"), p["body"], F.lit("\n"))), "")
    pieces = [title]
    if stamp is not None:
        pieces.insert(0, collection_frontmatter(F.col("collection"), F.size("p_"), F.lit(stamp)))
    if toc:
        pieces.append(F.concat(F.lit("## Table of Contents\n\n"), entries, F.lit("\n")))
    text = F.concat(*pieces, bodies)
    return parts.select("collection", F.size("p_").alias("n_files"), text.alias("markdown")).withColumn("tokens", estimate_tokens(F.col("markdown")))


def in_parts(pieces: DataFrame, part_bytes: int) -> DataFrame:
    """(collection, kind, name, piece), in order of kind, name and piece, as texts of bounded size: collection, part, start (bytes before it), n_bytes, markdown.

    Prefix sums of the pieces' sizes, over names and digests only, say where each piece begins and so which part it is in; texts
    move once, to their parts.  A part begins with the first piece that starts in its range, so it is at most one piece longer.
    """
    key = ["collection", "kind", "name", "d_"]
    rows = pieces.withColumn("d_", F.sha2(F.encode("piece", "UTF-8"), 256))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.first(F.octet_length("piece")).cast("long").alias("size"))
    before = F.sum(F.col("times") * F.col("size")).over(Window.partitionBy("collection").orderBy("kind", "name", "d_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    # equal pieces of one name follow one another
    each = sizes.select(*key, F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("i", "n"), (F.col("before") + (F.col("n") - 1) * F.col("size")).alias("at"))
    texts = rows.groupBy(*key).agg(F.first("piece").alias("piece"))
    placed = each.select(*key, "at", F.floor(F.col("at") / part_bytes).alias("part")).join(texts, key)
    out = placed.groupBy("collection", "part").agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "kind", "name", "d_", "piece"))).alias("p_"))
    text = F.array_join(F.transform("p_", lambda p: p["piece"]), "")
    return out.select("collection", "part", "start", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("markdown"))


def combined_parts(docs: DataFrame, stamp: str | None = None, toc: bool = True, part_bytes: int = 64 << 20) -> DataFrame:
    """What ``combined`` makes of (collection, name, body), in parts of about ``part_bytes``, for collections beyond one string.  Of equal names digests of bodies decide.

    Parts in order of their numbers, one after another, are the document; numbers may be left out where a piece fills several.
    """
    piece = lambda df, kind, name, text: df.select("collection", F.lit(kind).alias("kind"), name.alias("name"), text.alias("piece"))
    n_files = docs.groupBy("collection").agg(F.count(F.lit(1)).cast("int").alias("n"))
    head = F.concat(F.lit("# "), F.col("collection"), F.lit("\n\n"), F.lit("## Table of Contents\n\n" if toc else ""))
    if stamp is not None:
        head = F.concat(collection_frontmatter(F.col("collection"), F.col("n"), F.lit(stamp)), head)
    none, name = F.lit(""), F.col("name")
    out = piece(n_files, 0, none, head)
    if toc:
        out = out.union(piece(docs, 1, name, F.concat(F.lit("- ["), name, F.lit("](#"), slugify(name), F.lit(")\n"))))
        out = out.union(piece(n_files, 2, none, F.lit("\n")))
    out = out.union(piece(docs, 3, name, F.concat(F.lit("\n\n---\n## "), name, F.lit("\n\n"), F.col("body"), F.lit("\n"))))
    return in_parts(out, part_bytes)


def clipboard_parts(docs: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """What ``clipboard`` makes of (collection, name, body), in parts."""
    out = docs.select("collection", F.lit(0).alias("kind"), "name", F.concat(F.lit("\n\n---\n## "), base_name(F.col("name")), F.lit("\n\n"), F.col("body")).alias("piece"))
    out = in_parts(out, part_bytes)  # the first part's first blank lines go; they are counted as written nowhere
    trimmed = F.when(F.col("start") == 0, F.regexp_replace("markdown", r"(?U)\A\s+", "")).otherwise(F.col("markdown"))
    gone = F.lit(2)
    return out.withColumn("markdown", trimmed).withColumn("n_bytes", F.octet_length("markdown").cast("long")).withColumn("start", F.when(F.col("start") == 0, 0).otherwise(F.col("start") - gone).cast("long"))


def is_combined(path: Column) -> Column:
    """Outputs of earlier combinations, which aren't combined again."""
    return path.endswith("-combined.md") | base_name(path).contains("combined_master")


def clipboard(docs: DataFrame) -> DataFrame:
    """(collection, name, body) to one text for each collection, without title or contents."""
    parts = docs.groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("name", "body"))).alias("p_"))
    text = F.array_join(F.transform("p_", lambda p: F.concat(F.lit("\n\n---\n## "), base_name(p["name"]), F.lit("\n\n"), p["body"])), "")
    return parts.select("collection", F.regexp_replace(text, r"(?U)\A\s+", "").alias("text"))


def events(results: DataFrame) -> DataFrame:
    """One JSON line for each result."""
    return results.select(F.to_json(F.struct(F.lit("file").alias("event"), "path", "status", "output", "tokens", "source_tokens", "error")).alias("value"))


def combined_only(results: DataFrame, collection: str, stamp: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the combined document, summary) of a batch that leaves only the combined document, if at least two files were converted.

    The summary's tokens are then the combined document's.  Nothing is deleted: single outputs just aren't written.
    """
    done = results.filter("status = 'done'")
    one = combined(done.select(F.lit(collection).alias("collection"), F.col("output").alias("name"), F.col("markdown").alias("body")), stamp).filter("n_files > 1")
    total = batch_summary(results)
    both = total.withColumn("c_", F.lit(None).cast("long")).unionByName(one.select(F.col("tokens").cast("long").alias("c_")), allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])  # of two rows at most
    return one, both.withColumn("tokens", F.coalesce("c_", "tokens")).drop("c_")


def event_stream(results: DataFrame, combined_output: DataFrame | None = None, base_dir: str = "") -> DataFrame:
    """(seq, value): the JSON lines of a batch: its start, one line for each file, the combined document (output, tokens), and the summary."""
    line = lambda n, df, **cols: df.select(F.lit(n).alias("seq"), F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()])).alias("value"))
    total = results.agg(F.count(F.lit(1)).alias("total"))
    out = line(0, total, event=F.lit("start"), total=F.col("total"), base_dir=F.lit(base_dir))
    out = out.union(events(results).select(F.lit(1).alias("seq"), "value"))
    if combined_output is not None:
        out = out.union(line(2, combined_output, event=F.lit("combined"), output=F.col("output"), tokens=F.col("tokens")))
    summary = batch_summary(results)
    return out.union(line(3, summary, event=F.lit("summary"), **{c: F.col(c) for c in ("converted", "failed", "skipped", "tokens", "saved_vs_raw", "src_tokens", "out_comparable")}))


def recommended_model(os: Column, vulkan: Column, vram_mb: Column, ram_mb: Column) -> Column:
    """The speech model for a machine."""
    # Model names and memory limits that must equal the original's.
    vram, ram = F.coalesce(vram_mb, F.lit(0)), F.coalesce(F.nullif(ram_mb, F.lit(0)), F.lit(8192))
    gpu = F.coalesce(vulkan, F.lit(False))
    return (
        F.when(F.lower(os) == "macos", "parakeet-tdt-0.6b-v3").when(gpu & (vram >= 6144), "whisper-large-v3-turbo-q8_0").when(gpu & (vram >= 4096), "whisper-large-v3-turbo-q5_0").when(ram < 6144, "whisper-small-q5_1").otherwise("parakeet-tdt-0.6b-v3-int8")
    )


def active_model(installed: DataFrame, catalog: DataFrame, preferred: str = "", saved: str = "") -> DataFrame:
    """(model): the first installed (model) of the preferred one, the saved one and the catalog (seq, model) in its order; no row if none is."""
    first = [(i - 2, m.strip()) for i, m in enumerate((preferred or "", saved or "")) if m.strip()]
    spark = catalog.sparkSession
    wanted = catalog.select(F.col("seq").cast("long").alias("seq"), "model").union(spark.createDataFrame(first, "seq long, model string"))
    return wanted.join(installed.select("model"), "model", "left_semi").orderBy("seq", "model").limit(1).select("model")


def model_flags(catalog: DataFrame, recommended: Column | str, active: Column | str) -> DataFrame:
    """catalog (model) with recommended and active: whether a model is the one."""
    same = lambda x: F.col("model").eqNullSafe(F.lit(x) if isinstance(x, str) else x)
    return catalog.withColumn("recommended", same(recommended)).withColumn("active", same(active))


def gpu_decision(model: Column, vulkan: Column, vram_mb: Column, override: str | None = None) -> Column:
    """struct(gpu, reason): whether speech recognition should use the GPU."""
    # Settings, limits and reasons that must equal the original's (the first two name its setting there).
    say = lambda gpu, why: F.struct(F.lit(gpu).alias("gpu"), F.lit(why).alias("reason"))
    word = (override or "").strip()
    if word in ("0", "false", "off"):
        return say(False, "forced off by a setting")
    if word in ("1", "true", "on"):
        return say(True, "forced on by a setting")
    return (
        F.when(~F.coalesce(vulkan, F.lit(False)), say(False, "no Vulkan-capable GPU"))
        .when(F.coalesce(vram_mb, F.lit(0)) < 2048, say(False, "GPU has under 2 GB of dedicated memory"))
        .when(~model.startswith("whisper-large"), say(False, "small model: CPU avoids per-process Vulkan pipeline compilation"))
        .otherwise(say(True, "large model on a Vulkan GPU"))
    )


def error_code(kind: Column) -> Column:
    """Exit code of an error kind."""
    return F.when(kind.isin("invalid_args", "file_not_found", "model_missing"), 2).when(kind == "no_audio", 3).when(kind.isin("decode_error", "inference_error"), 1)


def dedupe_image_texts(images: DataFrame) -> DataFrame:
    """(doc_id, name, text) of read images to (doc_id, markdown): repeated texts once, in order of name; texts under three characters go."""
    rows = images.filter(F.length(F.trim("text")) >= 3).withColumn("key_", F.lower(strip(F.col("text"))))
    first = F.row_number().over(Window.partitionBy("doc_id", "key_").orderBy("name"))
    rows = rows.withColumn("n_", first).filter("n_ = 1")
    part = lambda p: F.concat(F.lit("\n\n### "), base_name(p["name"]), F.lit("\n\n"), p["text"])
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("p_"), F.count(F.lit(1)).alias("n_texts"))
    return out.select("doc_id", "n_texts", F.concat(F.lit("\n\n---\n\n## Text found in images\n"), F.array_join(F.transform("p_", part), "")).alias("markdown"))


def image_section(pictures: Column) -> Column:
    """What ``dedupe_image_texts`` makes of one document's array<struct<name, text, ...>>; null where none has a text."""
    read = F.filter(pictures, lambda p: F.length(F.trim(p["text"])) >= 3)
    named = F.sort_array(F.transform(read, lambda p: F.struct(p["name"].alias("name"), p["text"].alias("text"), F.lower(strip(p["text"])).alias("key"))))
    first = F.transform(F.array(named), lambda a: F.filter(a, lambda p, i: F.array_position(a["key"], p["key"]) == i + 1))[0]
    part = lambda p: F.concat(F.lit("\n\n### "), base_name(p["name"]), F.lit("\n\n"), p["text"])
    parts = F.transform(F.array(F.array_join(F.transform(first, part), "")), lambda t: F.when(t != "", F.concat(F.lit("\n\n---\n\n## Text found in images\n"), t)))
    return parts[0]


def read_boxes(boxes: Column, min_score: float = 0.5) -> Column:
    """array<struct<box array<array<double>>, text, score>> to text in reading order: by upper edge, then as given."""
    upper = lambda b: F.array_min(F.transform(b["box"], lambda p: p[1]))
    placed = F.transform(boxes, lambda b, i: F.struct(upper(b).alias("y"), i.alias("i"), b["text"].alias("text"), b["score"].alias("score")))
    # sort_array orders by the type itself; array_sort compares pair by pair by an expression
    ordered = F.sort_array(F.filter(placed, lambda b: (b["score"] >= min_score) & (F.trim(b["text"]) != "")))
    return F.transform(F.array(F.array_join(ordered["text"], "\n")), lambda t: F.when(F.length(F.trim(t)) >= 3, t).otherwise(""))[0]
