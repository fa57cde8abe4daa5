"""Transcripts: words and speaker turns to segments, turns and Markdown.

Words are rows (doc_id, seq, word, start, end), speaker turns rows (doc_id, seq,
speaker_id, start, end), segments rows (doc_id, seq, start, end, speaker, text).
What depends on neighbours only is written with windows over a transcript; what
depends on its own earlier decisions is a fold over the transcript's ordered array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import format_timestamp, join_words, round_hundredth, strip

MAX_GAP = 3.0
WORD = "struct<seq:bigint,word:string,start:double,end:double>"


def _ordered(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def assign_speakers(words: DataFrame, turns: DataFrame, bin_s: float = 10.0) -> DataFrame:
    """words with raw_speaker: the turn of greatest overlap, else the nearest to the word's middle (the earlier on ties), S1 without turns.

    Words meet only the turns that share a stretch of ``bin_s`` seconds with them.  Those that overlap none find
    their neighbours by two running extremes: the turn that has ended last, and the one that begins next.
    """
    mid = 0.5 * (F.col("start") + F.col("end"))
    stretch = F.sequence(F.floor(F.col("start") / bin_s), F.floor(F.greatest("start", "end") / bin_s))
    binned = turns.select("doc_id", F.explode(stretch).alias("bin_"), F.col("seq").alias("t_"), F.col("start").alias("from_"), F.col("end").alias("to_"), F.col("speaker_id").alias("who_"))
    overlap = F.greatest(F.lit(0.0), F.least(F.col("end"), F.col("to_")) - F.greatest(F.col("start"), F.col("from_")))
    met = words.select("doc_id", "seq", "start", "end", F.explode(stretch).alias("bin_")).join(binned, ["doc_id", "bin_"])
    met = met.withColumn("o_", overlap).filter((F.col("o_") > 0) | mid.between(F.col("from_"), F.col("to_")))
    met = met.groupBy("doc_id", "seq").agg(F.min(F.struct(-F.col("o_"), "t_", "who_"))["who_"].alias("met_"))
    rows = words.join(met, ["doc_id", "seq"], "left")
    # the others, among the ends and beginnings of their transcript's turns
    none, when = F.lit(None).cast("struct<at:double,t:bigint,who:string>"), F.col("at_")
    edge = lambda at, sign: F.struct(F.col(at).cast("double").alias("at"), (sign * F.col("seq")).cast("bigint").alias("t"), F.col("speaker_id").alias("who"))
    ends = turns.select("doc_id", F.lit(None).cast("bigint").alias("seq"), F.col("end").alias("at_"), F.lit(0).alias("kind_"), edge("end", -1).alias("ended_"), none.alias("begins_"))
    begins = turns.select("doc_id", F.lit(None).cast("bigint").alias("seq"), F.col("start").alias("at_"), F.lit(2).alias("kind_"), none.alias("ended_"), edge("start", 1).alias("begins_"))
    alone = rows.filter("met_ IS NULL").select("doc_id", "seq", mid.alias("at_"), F.lit(1).alias("kind_"), none.alias("ended_"), none.alias("begins_"))
    upto = Window.partitionBy("doc_id").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("doc_id").orderBy(F.desc("at_"), F.desc("kind_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ends.union(alone).union(begins).withColumn("before_", F.max("ended_").over(upto)).withColumn("after_", F.min("begins_").over(onward)).filter("kind_ = 1")
    before = F.when(F.col("before_").isNotNull(), F.struct((when - F.col("before_.at")).alias("d"), (-F.col("before_.t")).alias("t"), F.col("before_.who").alias("who")))
    after = F.when(F.col("after_").isNotNull(), F.struct((F.col("after_.at") - when).alias("d"), F.col("after_.t").alias("t"), F.col("after_.who").alias("who")))
    near = near.select("doc_id", "seq", F.least(before, after)["who"].alias("near_"))
    return rows.join(near, ["doc_id", "seq"], "left").withColumn("raw_speaker", F.coalesce("met_", "near_", F.lit("S1"))).drop("met_", "near_")


def clamp_words(words: DataFrame, duration: Column) -> DataFrame:
    """Word times within [0, duration]; without a duration, the word's own end bounds them."""
    most = F.when(duration > 0, duration).otherwise(F.col("end"))
    start = F.least(F.greatest(F.col("start"), F.lit(0.0)), most)
    return words.withColumn("s_", start).withColumn("end", F.least(F.greatest(F.col("end"), F.col("s_")), most)).withColumn("start", F.col("s_")).drop("s_")


def smooth_flips(words: DataFrame, max_word: float = 0.55, max_gap: float = 0.75) -> DataFrame:
    """A short word between two of one other speaker takes that speaker, from left to right, seeing what was already changed.

    Only a short word with short pauses on both sides can flip, so a word that isn't one ends what earlier
    flips can do: the fold runs over such words and the one before them, not over the transcript.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    may = (F.col("end") - F.col("start") < max_word) & (F.col("start") - F.lag("end").over(order) < max_gap) & (F.lead("start").over(order) - F.col("end") < max_gap)
    rows = words.select("doc_id", "seq", "word", "start", "end", "raw_speaker", F.lead("raw_speaker").over(order).alias("after"), F.coalesce(may, F.lit(False)).alias("may"))
    rows = rows.withColumn("run", F.sum((~F.col("may")).cast("int")).over(order))
    runs = rows.groupBy("doc_id", "run").agg(_ordered("seq", "word", "start", "end", "raw_speaker", "after").alias("ws_"))

    def add(done: Column, x: Column) -> Column:
        left = F.element_at(done, -1)
        return F.array_append(done, F.when((left == x["after"]) & (x["raw_speaker"] != left), left).otherwise(x["raw_speaker"]))

    spoken = F.aggregate(F.slice("ws_", 2, F.size("ws_")), F.array(F.element_at("ws_", 1)["raw_speaker"]).cast("array<string>"), add)
    out = runs.select("doc_id", F.explode(F.arrays_zip("ws_", spoken.alias("speaker"))).alias("x"))
    return out.select("doc_id", *[F.col(f"x.ws_.{c}").alias(c) for c in ("seq", "word", "start", "end")], F.col("x.speaker").alias("raw_speaker"))


def distinct_speakers(segments: DataFrame) -> DataFrame:
    """(doc_id, n_speakers): the speakers whose names a transcript has."""
    return segments.groupBy("doc_id").agg(F.count_distinct("speaker").alias("n_speakers"))


def canonical_speakers(words: DataFrame, raw: str = "raw_speaker") -> DataFrame:
    """Adds speaker: Speaker 1, 2, ... by first appearance."""
    first = Window.partitionBy("doc_id", raw)
    rows = words.withColumn("first_", F.min("seq").over(first))
    return rows.withColumn("speaker", F.concat(F.lit("Speaker "), F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_")).cast("string"))).drop("first_")


def _runs(rows: DataFrame, key: Column, gap: float) -> DataFrame:
    """Numbers runs of one key without a gap above ``gap`` from the run's furthest end (needs end >= start)."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumn("k_", key).withColumn("new_", F.col("k_").isNull() | ~F.col("k_").eqNullSafe(F.lag("k_").over(order)) | (F.row_number().over(order) == 1))
    rows = rows.withColumn("run_", F.sum(F.col("new_").cast("int")).over(order))
    far = F.max("end").over(Window.partitionBy("doc_id", "run_").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("far_", far)
    rows = rows.withColumn("break_", (F.col("far_").isNull() | (F.col("start") - F.col("far_") > gap)).cast("int"))
    return rows.withColumn("turn", F.sum("break_").over(order)).drop("k_", "new_", "run_", "far_", "break_")


def diarized_segments(words: DataFrame) -> DataFrame:
    """Segments of words with a canonical speaker: broken at a change of speaker or a pause above three seconds."""
    rows = _runs(words, F.col("speaker"), MAX_GAP)
    out = rows.groupBy("doc_id", "turn").agg(F.min_by("start", "seq").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"), F.transform(_ordered("seq", "word"), lambda x: x["word"]).alias("w_"))
    out = out.select("doc_id", F.col("turn").alias("seq"), round_hundredth(F.col("start")).alias("start"), round_hundredth(F.col("end")).alias("end"), "speaker", join_words(F.col("w_")).alias("text"))
    return out.filter("text <> ''")


def diarize(words: DataFrame, turns: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Words and speaker turns to segments: attribution, smoothing, names, breaks.  durations: (doc_id, duration)."""
    if durations is not None:
        words = clamp_words(words.join(durations, "doc_id", "left"), F.col("duration")).drop("duration")
    else:
        words = clamp_words(words, F.lit(0.0))
    return diarized_segments(canonical_speakers(smooth_flips(assign_speakers(words, turns))))


def fallback_segment(docs: DataFrame, speaker: str | None) -> DataFrame:
    """(doc_id, text, duration) of transcripts without words: one segment over all, or none for blank texts."""
    out = docs.select("doc_id", F.lit(1).cast("bigint").alias("seq"), F.lit(0.0).alias("start"), round_hundredth(F.greatest(F.col("duration"), F.lit(0.0))).alias("end"), F.lit(speaker).cast("string").alias("speaker"), strip(F.col("text")).alias("text"))
    return out.filter("text <> ''")


def undiarized_segments(words: DataFrame, max_gap: float = 2.5, sentence_after: float = 15.0, longest: float = 45.0) -> DataFrame:
    """Segments by pauses, sentence ends after a while, or length: each break starts the count anew, so this is a fold.

    A pause after everything that was said before breaks any segment, so a transcript is first cut at such pauses, and each
    stretch between two of them is folded by itself.
    """
    done = "array<struct<start:double,end:double,words:array<string>>>"
    w = F.col("ws_")
    first = F.element_at(w, 1)
    zero = F.greatest(F.lit(0.0), first["start"])
    state = F.struct(F.array().cast(done).alias("done"), zero.alias("s"), F.greatest(first["end"], zero).alias("e"), F.array(first["word"]).alias("t"))

    def push(a: Column) -> Column:
        return F.array_append(a["done"], F.struct(a["s"].alias("start"), a["e"].alias("end"), a["t"].alias("words")))

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a["t"], -1)
        stop = (x["start"] - a["e"] > max_gap) | (last.rlike(r"[.?!]\z") & (a["e"] - a["s"] >= sentence_after)) | (a["e"] - a["s"] >= longest)
        s = F.greatest(F.lit(0.0), x["start"])
        return F.struct(
            F.when(stop, push(a)).otherwise(a["done"]).alias("done"),
            F.when(stop, s).otherwise(a["s"]).alias("s"),
            F.when(stop, F.greatest(x["end"], s)).otherwise(F.greatest(a["e"], x["end"])).alias("e"),
            F.when(stop, F.array(x["word"])).otherwise(F.array_append(a["t"], x["word"])).alias("t"),
        )

    order = Window.partitionBy("doc_id").orderBy("seq")
    far = F.max(F.greatest("end", "start", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = words.select("doc_id", "seq", "word", "start", "end", F.coalesce(F.col("start") - far > max_gap, F.lit(False)).alias("cut_"))
    rows = rows.withColumn("part_", F.sum(F.col("cut_").cast("int")).over(order))
    rows = rows.groupBy("doc_id", "part_").agg(_ordered("seq", "word", "start", "end").alias("ws_"))
    out = rows.select("doc_id", "part_", F.posexplode(F.aggregate(F.slice(w, 2, F.size(w)), state, add, push)).alias("at_", "x"))
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("part_", "at_")))
    out = out.select("doc_id", F.col("seq").cast("bigint").alias("seq"), round_hundredth(F.col("x.start")).alias("start"), round_hundredth(F.col("x.end")).alias("end"), F.lit(None).cast("string").alias("speaker"), join_words(F.col("x.words")).alias("text"))
    return out.filter("text <> ''")


def is_special_token(token: Column) -> Column:
    """Marks of speech models, and blanks."""
    t = strip(token)
    return (t == "") | t.rlike(r"\A\[_[\s\S]*\]\z") | t.rlike(r"\A<\|[\s\S]*\|>\z") | t.isin("<blk>", "<sos/eos>", "<s>", "</s>")


def merge_subwords(tokens: DataFrame) -> DataFrame:
    """(doc_id, seq, token, start, end) to words: a token with a leading space or U+2581 begins a word."""
    rows = tokens.filter(~is_special_token(F.col("token")))
    order = Window.partitionBy("doc_id").orderBy("seq")
    begins = F.col("token").rlike("\\A(?U)(\\s|▁)") | (F.row_number().over(order) == 1)
    rows = rows.withColumn("b_", begins.cast("int")).withColumn("n_", F.sum("b_").over(order)).withColumn("piece", strip(F.replace(F.col("token"), F.lit("▁"), F.lit(" "))))
    out = rows.groupBy("doc_id", "n_").agg(F.array_join(F.transform(_ordered("seq", "piece"), lambda x: x["piece"]), "").alias("word"), F.min_by("start", "seq").alias("start"), F.max("end").alias("end"))
    return out.filter("word <> ''").select("doc_id", F.col("n_").alias("seq"), "word", "start", "end")


def interpolate_words(segments: DataFrame) -> DataFrame:
    """Words of segments without word times: the time is dealt by characters; the last word ends with its segment."""
    rows = segments.select("doc_id", "seq", "start", "end", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("i", "word"))
    order = Window.partitionBy("doc_id", "seq").orderBy("i")
    all_ = Window.partitionBy("doc_id", "seq")
    chars = F.length("word")
    rows = rows.withColumn("upto", F.sum(chars).over(order)).withColumn("total", F.sum(chars).over(all_)).withColumn("n", F.count(F.lit(1)).over(all_))
    zero, span = F.greatest(F.lit(0.0), F.col("start")), F.greatest(F.lit(0.05), F.col("end") - F.col("start"))
    begin = zero + span * (F.col("upto") - chars) / F.col("total")
    end = F.when(F.col("i") == F.col("n") - 1, F.greatest(F.col("end"), begin)).otherwise(zero + span * F.col("upto") / F.col("total"))
    return rows.select("doc_id", "seq", F.col("i").cast("bigint").alias("i"), "word", begin.alias("start"), end.alias("end"))


def rebase_chunks(tokens: DataFrame, chunk: float = 30.0) -> DataFrame:
    """(doc_id, seq, chunk_no, token, offset, chunk_end) to absolute times: a token ends where the next of its chunk starts."""
    base = F.col("chunk_no") * chunk
    after = F.lead("offset").over(Window.partitionBy("doc_id", "chunk_no").orderBy("seq"))
    return tokens.withColumn("start", base + F.col("offset")).withColumn("end", F.coalesce(base + after, F.col("chunk_end"))).drop("offset", "chunk_no", "chunk_end")


def clamp_tokens(tokens: DataFrame) -> DataFrame:
    """(t0, t1, seg_start, seg_end): times that are missing or outside of the segment take its bounds."""
    inside = lambda t: t.isNotNull() & (t >= F.col("seg_start")) & (t <= F.col("seg_end"))
    return tokens.withColumn("start", F.when(inside(F.col("t0")), F.col("t0")).otherwise(F.col("seg_start"))).withColumn("end", F.when(inside(F.col("t1")), F.col("t1")).otherwise(F.col("seg_end")))


def merge_turns(segments: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Joins segments of one speaker whose pause is at most ``max_gap``; speakers are trimmed, unnamed ones (null) stay apart, blank texts go."""
    rows = segments.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter("text <> ''")
    rows = rows.withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("end", F.greatest("start", "end"))
    rows = rows.withColumn("speaker", F.when(F.col("speaker") != "", strip(F.col("speaker"))))
    rows = _runs(rows, F.col("speaker"), max_gap)
    out = rows.groupBy("doc_id", "turn").agg(F.min_by("start", "seq").alias("start"), F.max("end").alias("end"), F.min_by("speaker", "seq").alias("speaker"), F.array_join(F.transform(_ordered("seq", "text"), lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_segments"))
    return out.select("doc_id", F.col("turn").alias("seq"), "start", "end", "speaker", "text", "n_segments")


def render_transcripts(titles: DataFrame, segments: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """(doc_id, title) and segments to (doc_id, markdown), one document each."""
    named = F.when(F.col("speaker") != "", F.concat(F.lit(" "), F.col("speaker"), F.lit(":**"))).otherwise("**")
    line = F.concat(F.lit("**["), format_timestamp(F.col("start")), F.lit("]"), named, F.lit(" "), F.col("text"))
    turns = merge_turns(segments, max_gap).withColumn("line", line)
    bodies = turns.groupBy("doc_id").agg(F.array_join(F.transform(_ordered("seq", "line"), lambda x: x["line"]), "\n\n").alias("body"))
    out = titles.join(bodies, "doc_id", "left")
    body = F.coalesce("body", F.lit("*(No speech detected in audio track.)*"))
    return out.select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def speaker_hint(hint: Column) -> Column:
    """struct(clusters, threshold) for the diarizer."""
    of = lambda n, t: F.struct(F.lit(n).cast("int").alias("clusters"), F.lit(t).alias("threshold"))
    number = F.when(hint.rlike(r"\A[1-9]\d{0,8}\z"), hint.cast("int"))
    return F.when(hint == "4+", of(-1, 0.38)).when(number.isNotNull(), F.struct(number.alias("clusters"), F.lit(0.5).alias("threshold"))).otherwise(of(-1, 0.5))
