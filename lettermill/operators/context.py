"""Messages with all that belongs to them: hydration, threads, header parents, the ingest ledger, segment pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hydrate(messages: DataFrame, recipients: DataFrame, attachments: DataFrame, uids: DataFrame | None = None, key: str = "uid") -> DataFrame:
    """``messages`` with recipients (sorted, distinct) and attachments (structs of line, name, size in order), empty where there are none.

    Children are grouped before they meet the messages.  With ``uids`` all three
    sides are cut to those messages first, whatever their number.
    """
    if uids is not None:
        messages, recipients, attachments = (side.join(uids, key, "left_semi") for side in (messages, recipients, attachments))
    people = recipients.groupBy(key).agg(F.array_sort(F.collect_set("recipient")).alias("recipients"))
    files = attachments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "name", "size"))).alias("attachments"))
    both = messages.join(people, key, "left").join(files, key, "left")
    empty = {c: F.array().cast(both.schema[c].dataType) for c in ("recipients", "attachments")}
    return both.withColumns({c: F.coalesce(c, none) for c, none in empty.items()})


def embedding_input(rows: DataFrame, body: str, defaults: dict[str, str], body_required: bool = True) -> DataFrame:
    """The columns an encoder needs, missing values replaced; rows without a body go unless the flag is off."""
    kept = rows.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "") if body_required else rows
    return kept.withColumns({column: F.coalesce(column, F.lit(value)) for column, value in defaults.items()})


def scalar(rows: DataFrame, column: str) -> Column:
    """A metadata value as text: lists joined by a comma, records as JSON."""
    kind = rows.schema[column].dataType.typeName()
    if kind == "array":
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ", ")
    return F.to_json(column) if kind in ("struct", "map") else F.col(column).cast("string")


def thread_members(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, uid, date): of each thread the messages that name it, else those for which it was inferred."""
    named = messages.join(threads, F.col("conversation_id") == F.col("thread_id")).select("thread_id", "uid", "date")
    left = threads.join(named.select("thread_id").distinct(), "thread_id", "left_anti")
    guessed = messages.join(left, F.col("inferred_thread_id") == F.col("thread_id")).select("thread_id", "uid", "date")
    return named.unionByName(guessed)


def thread_place(at: Column, raw: Column, uid: Column, *thread: str) -> Column:
    """Place in the thread: by time, what has no readable date last and by its raw date, then by uid."""
    return F.row_number().over(Window.partitionBy(*thread).orderBy(at.asc_nulls_last(), raw, uid))


def bare_id(message_id: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(message_id, F.lit(""))), "^<|>$", "")


def header_parents(children: DataFrame, archive: DataFrame) -> DataFrame:
    """(uid, parent_uid, via): the message that In-Reply-To names, else the last of the references that the archive has.

    ``children`` have uid, in_reply_to, references (array); ``archive`` uid,
    message_id, thread_id, date.  Of copies of a parent one in a thread wins, then
    the earliest, then the smallest uid.
    """
    direct = children.select("uid", bare_id(F.col("in_reply_to")).alias("wanted"), F.lit(None).cast("int").alias("place"))
    others = children.select("uid", F.posexplode("references").alias("place", "wanted")).select("uid", bare_id(F.col("wanted")).alias("wanted"), "place")
    asked = direct.unionByName(others).where("wanted <> ''")
    stored = archive.select(F.col("uid").alias("parent_uid"), bare_id(F.col("message_id")).alias("wanted"), (F.coalesce("thread_id", F.lit("")) == "").alias("loose"), F.col("date").alias("parent_date"))
    order = Window.partitionBy("uid").orderBy(F.col("place").desc_nulls_first(), "loose", "parent_date", "parent_uid")
    met = asked.join(stored, "wanted").where("uid <> parent_uid").withColumn("r", F.row_number().over(order)).where("r = 1")
    return met.select("uid", "parent_uid", F.when(F.col("place").isNull(), "in_reply_to").otherwise("references").alias("via"))


def ledger(marks: DataFrame) -> DataFrame:
    """The state of each uid: its last mark (uid, status, attachment_status, at, mark), and how often it failed."""
    last = F.max_by(F.struct("status", "attachment_status"), F.struct("at", "mark"))
    return marks.groupBy("uid").agg(last.alias("s"), F.sum((F.col("status") == "failed").cast("long")).alias("failures")).select("uid", "s.status", "s.attachment_status", "failures")


def completed(states: DataFrame, messages: DataFrame, attachments_required: bool = False) -> DataFrame:
    """uids that need no more ingestion; messages: uid, has_attachments."""
    done = states.where("status = 'completed'").join(messages, "uid")
    return (done.where("attachment_status = 'completed' or not has_attachments") if attachments_required else done).select("uid")


def merge_mentions(stored: DataFrame, extracted: DataFrame, keys: list[str], again: bool) -> DataFrame:
    """Mention counts after an extraction: added for new mentions, the larger one when the same text is extracted ``again``."""
    both = stored.withColumnRenamed("mentions", "old").join(extracted.withColumnRenamed("mentions", "new"), keys, "full_outer")
    old, new = F.coalesce("old", F.lit(0)), F.coalesce("new", F.lit(0))
    return both.select(*keys, (F.greatest(old, new) if again else old + new).alias("mentions"))


#: Segment groups of the pivot, and the kinds of segments in each; None takes all.
SEGMENT_GROUPS = {"authored_segment": ("authored_body",), "quoted_segment": ("quoted_reply", "forwarded_message"), "forwarded_header": ("header_block",), "segment": None}


def segment_pivot(segments: DataFrame, key: str = "uid") -> DataFrame:
    """One row a message: text (segments joined by line ends, in order) and least ordinal of each segment group."""
    found = []
    for name, kinds in SEGMENT_GROUPS.items():
        own = F.lit(True) if kinds is None else F.col("segment_type").isin(*kinds)
        texts = F.array_sort(F.collect_list(F.when(own & F.col("text").isNotNull(), F.struct("ordinal", "text"))))
        found += [F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda s: s["text"]), "\n")).alias(f"{name}_text"), F.min(F.when(own, F.col("ordinal"))).alias(f"{name}_ordinal")]
    return segments.groupBy(key).agg(*found)


def short(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) < 8


def analytics_text(subject: Column, authored: Column, surfaces: list[tuple[str, Column]], attachment: Column) -> Column:
    """struct(text, source): the authored segment, else the first surface with text, after the subject if it is short, else subject or attachment."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    pick = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    subject, authored, attachment = clean(subject), clean(authored), clean(attachment)
    out = F.when(authored != "", pick(authored, "segment:authored_body"))
    for name, surface in surfaces:
        body = clean(surface)
        out = out.when((body != "") & (subject != "") & short(body), pick(F.concat(subject, F.lit("\n"), body), f"subject_plus_{name}")).when(body != "", pick(body, name))
    out = out.when((subject != "") & (attachment != ""), pick(F.concat(subject, F.lit("\n"), attachment), "subject_plus_attachment_text"))
    return out.when(subject != "", pick(subject, "subject")).when(attachment != "", pick(attachment, "attachment_text")).otherwise(pick(F.lit(""), ""))


def entity_text(surfaces: list[tuple[str, Column]], most: int | None = 12_000) -> Column:
    """struct(text, sources): distinct surfaces joined by line ends; of a longer text two thirds from its head, one from its tail."""
    parts = F.array(*(F.struct(F.lit(name).alias("name"), F.trim(F.coalesce(c, F.lit(""))).alias("text")) for name, c in surfaces))
    own = F.filter(parts, lambda p, i: (p["text"] != "") & (F.array_position(F.transform(parts, lambda q: q["text"]), p["text"]) == i + 1))
    text = F.array_join(F.transform(own, lambda p: p["text"]), "\n")
    if most is not None:
        head, tail = int(most * 0.67), most - int(most * 0.67)
        cut = F.concat(F.regexp_replace(F.substring(text, 1, head), r"\s+\z", ""), F.lit("\n[... entity text truncated for extraction ...]\n"), F.regexp_replace(F.right(text, F.lit(tail)), r"\A\s+", ""))
        text = F.when(F.length(text) > most, cut).otherwise(text)
    return F.struct(text.alias("text"), F.array_join(F.transform(own, lambda p: p["name"]), "+").alias("sources"))


def surface_rows(pivoted: DataFrame, key: str = "uid") -> DataFrame:
    """One row for each surface of a message that has text: scope, source, ordinal, text."""
    scopes = (("authored_body", "authored_segment"), ("quoted_body", "quoted_segment"), ("forwarded_header", "forwarded_header"), ("segment_text", "segment"))
    found = [F.struct(F.lit(scope).alias("scope"), F.lit("message_segments").alias("source"), F.col(f"{group}_ordinal").alias("ordinal"), F.col(f"{group}_text").alias("text")) for scope, group in scopes]
    if "attachment_text" in pivoted.columns:
        found.append(F.struct(F.lit("attachment_text").alias("scope"), F.lit("attachments").alias("source"), F.lit(None).cast(pivoted.schema["segment_ordinal"].dataType).alias("ordinal"), F.col("attachment_text").alias("text")))
    return pivoted.select(key, F.inline(F.array(*found))).where(F.trim(F.coalesce("text", F.lit(""))) != "")


def occurrences(rows: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """``rows`` with start, stop and surface of every place where the column ``term`` occurs in ``text``, whatever the case."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(F.col(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = rows.where(F.trim(F.coalesce(F.col(term), F.lit(""))) != "").withColumn("pieces_", F.split(F.col(text), quoted))
    width = F.length(F.col(term))
    # after piece i lie i pieces and i - 1 terms
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    ends = F.aggregate(F.slice("pieces_", F.lit(1), F.size("pieces_") - 1), step, lambda a, p: F.struct((a["at"] + F.length(p) + width).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found")), lambda a: a["found"])
    each = pieces.withColumn("start", F.explode(ends)).drop("pieces_")
    return each.withColumn("stop", F.col("start") + width).withColumn("surface", F.substring(F.col(text), F.col("start") + 1, width))


def snippet_bounds(body: Column, snippet: Column) -> Column:
    """struct(start, stop, mode): where a snippet stands in a body, exactly or with any white space for its spaces; null if nowhere."""
    flat = F.replace(F.trim(F.regexp_replace(snippet, r"\s+", " ")), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(F.lit(r"\Q"), F.replace(flat, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    loose = F.call_function("regexp_extract", body, pattern, F.lit(0))
    at = lambda found, mode: F.struct((F.instr(body, found) - 1).alias("start"), (F.instr(body, found) - 1 + F.length(found)).alias("stop"), F.lit(mode).alias("mode"))
    known = (F.length(body) > 0) & (F.length(snippet) > 0)
    return F.when(known & F.contains(body, snippet), at(snippet, "exact")).when(known & (F.length(loose) > 0), at(loose, "collapsed"))


def display_date(at: Column) -> Column:
    day = F.date_format(at, "MMMM dd, yyyy")
    timed = F.concat(day, F.date_format(at, ", hh:mm a"))
    return F.coalesce(F.replace(F.when((F.hour(at) > 0) | (F.minute(at) > 0), timed).otherwise(day), F.lit(" 0"), F.lit(" ")), F.lit(""))


def display_size(size: Column) -> Column:
    """Bytes, KB or MB; a tie goes to the even digit, as C's printf does, where Java's rounds it up."""
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(size / unit, 1))
    return F.when(size.isNull() | (size < 0), "").when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, scaled(1024, "KB")).otherwise(scaled(1 << 20, "MB"))
