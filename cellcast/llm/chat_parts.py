"""Chat formatting with typed content parts (DataFrame functions only).

A message holds an ordered list of parts, each a text, image, audio or document.  A
visitor (one ``transform`` over the parts) turns texts into escaped text and the others
into placeholders, and records each attachment's reference and the number of tokens its
placeholder expands to.  Every turn becomes

    <|turn|>ROLE \\n CONTENT <|end|>

Texts have ``&``, ``<`` and ``[`` escaped, so no control string of this template, nor of
the common bracket or angle templates, can occur inside one, and unescaping gives the
text back exactly.  A formatted conversation is a list of segments with a loss flag and the
source texts of their placeholders; the string is their concatenation, ``loss_spans`` are its
code-point ranges, and ``restored`` puts the sources back.

``typed_parts`` finds parts in a plain text: inline references ``![label](path.ext#fragment)``
whose extension names an image, audio or document file are attachments, all else is text.  Sizes come
from media fragments (``#xywh=x,y,width,height``, ``#t=start,end`` in whole seconds); a reference without one
has the default size below, and a document reference stands for one page.

Defined results: null role and null text are empty; a null part list is one empty text;
a null conv_id is a conversation of its own; turns that tie are ordered by role and
content; repeated rows are repeated turns; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op8_chat_parts"

TURN, END = "<|turn|>", "<|end|>"
PART = "array<struct<kind:string,text:string,ref:string,width:int,height:int,duration_ms:bigint,pages:int>>"
# Tokens that an attachment expands to.
IMAGE_PATCH = 28        # one token per patch of so many pixels each way
AUDIO_MS = 40           # one token per so many milliseconds
PAGE_TOKENS = 256       # per page of a document
# Files by kind, and the size of a reference that states none.
EXTENSIONS = {"image": ("png", "jpg", "jpeg", "gif", "webp"), "audio": ("wav", "mp3", "flac", "ogg"), "document": ("pdf", "docx")}
IMAGE_SIDE, AUDIO_DEFAULT_MS, DEFAULT_PAGES = 448, 30_000, 1
# No class crosses a bracket, so a long run of opening marks is scanned once.
REFERENCE = r"!\[[^\[\]\n]*\]\([^()#\x00-\x20]+\.(?:%s)(?:#[^()\x00-\x20]*)?\)" % "|".join(e for es in EXTENSIONS.values() for e in es)
PATH = r"\]\(([^()#\x00-\x20]+\.([a-z0-9]+))(?:#([^()\x00-\x20]*))?\)$"
XYWH = r"(?:^|&)xywh=(?:pixel:)?[0-9]{1,6},[0-9]{1,6},([0-9]{1,6}),([0-9]{1,6})(?:&|$)"
SECONDS = r"(?:^|&)t=([0-9]{1,6}),([0-9]{1,6})(?:&|$)"
MARK = r"<\|(?:image|audio|document)\|>"
WORDS = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+"


def escape(text):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text):
    for raw, safe in (("[", "&#91;"), ("<", "&lt;"), ("\n", "&#10;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text):
    """A part list that holds one text."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                     ("duration_ms", "bigint"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *none)).cast(PART)


def _reference(source):
    """The attachment part of one inline reference; its text is the source."""
    path, ext, fragment = (F.regexp_extract(source, PATH, i) for i in (1, 2, 3))
    kind = F.when(ext.isin(*EXTENSIONS["image"]), "image").when(ext.isin(*EXTENSIONS["audio"]), "audio").otherwise("document")
    number = lambda pattern, i: F.regexp_extract(fragment, pattern, i).try_cast("int")
    start, end = number(SECONDS, 1), number(SECONDS, 2)
    return F.struct(
        kind.alias("kind"), source.alias("text"), path.alias("ref"),
        F.when(kind == "image", F.coalesce(number(XYWH, 1), F.lit(IMAGE_SIDE))).alias("width"),
        F.when(kind == "image", F.coalesce(number(XYWH, 2), F.lit(IMAGE_SIDE))).alias("height"),
        F.when(kind == "audio", F.when(end > start, (end - start).cast("long") * 1000).otherwise(F.lit(AUDIO_DEFAULT_MS))).cast("long").alias("duration_ms"),
        F.when(kind == "document", F.lit(DEFAULT_PAGES)).alias("pages"))


def typed_parts(text):
    """A text as its parts in order: texts (also empty ones) around the inline references in it."""
    text = F.coalesce(text, F.lit(""))
    around = F.transform(F.split(text, REFERENCE, -1), lambda x: F.get(text_part(x), F.lit(0)))
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _reference).cast(PART)
    return F.flatten(F.transform(around, lambda x, i: F.filter(F.array(x, F.get(found, i)), lambda y: y.isNotNull())))


def part_tokens(p):
    """Tokens that a part expands to; a text's are counted as words and marks."""
    def up(a, b):
        return F.ceil(F.coalesce(a, F.lit(0)) / F.lit(b))
    words = F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(WORDS))
    return (F.when(p["kind"] == "image", up(p["width"], IMAGE_PATCH) * up(p["height"], IMAGE_PATCH))
            .when(p["kind"] == "audio", up(p["duration_ms"], AUDIO_MS))
            .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
            .otherwise(words)).cast("long")


def _attached(p):
    return p["kind"].isin(*EXTENSIONS)


def visit(parts):
    """Flatten a part list to the content string with placeholders."""
    return F.array_join(F.transform(parts, lambda p: F.when(
        _attached(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(
        escape(F.coalesce(p["text"], F.lit(""))))), "")


def attachments(parts):
    return F.transform(F.filter(parts, _attached), lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, parts.  One row per conversation:

    conv_id, segments (text, loss, sources: the texts of its placeholders) in order, loss_spans (start, end)
    in code points of the concatenated segments, attachments (kind, ref, tokens) in placeholder order, n_tokens.
    Offsets are a running sum in turn order, so the work is linear in the turns.
    """
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce(F.col("parts").cast(PART), text_part(F.lit(""))).alias("parts"))
    m = m.withColumn("content", visit(F.col("parts"))).select(
        "conv_id", "turn", "role", "content", attachments(F.col("parts")).alias("att"),
        F.transform(F.filter("parts", _attached), lambda p: p["text"]).alias("sources"),
        F.aggregate(F.transform("parts", part_tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    m = m.withColumn("head", F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n")))
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "sources")
    size = (F.length("head") + F.length("content") + len(END)).cast("long")
    m = m.withColumn("n", F.row_number().over(turns)).withColumn(
        "at", F.coalesce(F.sum(size).over(turns.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    loss = F.col("role") == "assistant"
    begin = F.col("at") + F.length("head")
    none = F.array().cast("array<string>").alias("sources")
    segs = F.array(F.struct(F.col("head").alias("text"), F.lit(False).alias("loss"), none),
                   F.struct(F.col("content").alias("text"), loss.alias("loss"), "sources"),
                   F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"), none))
    one = F.struct("n", segs.alias("segs"), "att", "tokens",
                   F.when(loss, F.struct(begin.alias("start"), (begin + F.length("content")).alias("end"))).alias("span"))
    c = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return c.select("conv_id", F.flatten(F.transform("t", lambda x: x["segs"])).alias("segments"),
                    F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
                    F.flatten(F.transform("t", lambda x: x["att"])).alias("attachments"),
                    F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"))


def formatted(segments):
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def restored(segment):
    """A segment's text with the escaped source of each placeholder in its place; one without a source stays a placeholder."""
    marks = F.regexp_extract_all(segment["text"], F.lit(MARK), F.lit(0))
    return F.array_join(F.flatten(F.transform(F.split(segment["text"], MARK, -1), lambda x, i: F.array(
        x, F.coalesce(escape(F.get(segment["sources"], i)), F.get(marks, i))))), "")


def read_turns(text):
    """The (role, text) turns of a formatted string; placeholders stay as they are."""
    def turn(x):
        body = F.substr(x, F.lit(len(TURN) + 1))
        at = F.instr(body, "\n")
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + 1)).alias("text"))
    return F.transform(F.filter(F.split(text, r"<\|end\|>", -1), lambda x: x != ""), turn)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = store.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = conv.unionByName(more).select("conv_id", "turn", "role", typed_parts(F.col("text")).alias("parts"))
    out = store.save(format_conversations(rows), "chat")
    back = out.select("conv_id", formatted(F.col("segments")).alias("whole"), F.array_join(F.transform("segments", restored), "").alias("full"),
                      F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(restored(s))), "").alias("loss"),
                      "n_tokens", "attachments")
    back = back.withColumn("turns", read_turns(F.col("full")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.length("whole").cast("long").alias("formatted_chars"), "n_tokens", F.size("attachments").cast("long").alias("n_attachments"),
                       F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
                       F.array_join(F.transform("attachments", lambda a: a["ref"]), "\n").alias("attachment_refs"))


def _esc(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


_KIND = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es)}) THEN '{k}'" for k, es in EXTENSIONS.items()) + " END"
_NUMBER = "TRY_CAST(regexp_extract(fragment, '{}', {}) AS BIGINT)".format
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
rows AS (SELECT row_number() OVER () AS id, *, regexp_extract_all(text, '{REFERENCE}') AS sources, string_split_regex(text, '{REFERENCE}') AS around FROM c),
found AS (SELECT id, place, regexp_extract(source, '{PATH}', 1) AS ref, regexp_extract(source, '{PATH}', 2) AS ext, regexp_extract(source, '{PATH}', 3) AS fragment
  FROM (SELECT id, unnest(sources) AS source, generate_subscripts(sources, 1) AS place FROM rows)),
sized AS (SELECT id, place, ref, {_KIND} AS kind,
  CAST(ceil(coalesce({_NUMBER(XYWH, 1)}, {IMAGE_SIDE}) / {IMAGE_PATCH}.0) * ceil(coalesce({_NUMBER(XYWH, 2)}, {IMAGE_SIDE}) / {IMAGE_PATCH}.0) AS BIGINT) AS image_tokens,
  CAST(ceil(CASE WHEN {_NUMBER(SECONDS, 2)} > {_NUMBER(SECONDS, 1)} THEN ({_NUMBER(SECONDS, 2)} - {_NUMBER(SECONDS, 1)}) * 1000 ELSE {AUDIO_DEFAULT_MS} END / {AUDIO_MS}.0) AS BIGINT) AS audio_tokens
  FROM found),
att AS (SELECT id, count(*) AS n, list(kind ORDER BY place) AS kinds, string_agg(ref, chr(10) ORDER BY place) AS refs,
  CAST(sum(CASE kind WHEN 'image' THEN image_tokens WHEN 'audio' THEN audio_tokens ELSE {DEFAULT_PAGES * PAGE_TOKENS} END) AS BIGINT) AS tokens FROM sized GROUP BY id),
typed AS (SELECT rows.*, n, refs, tokens, list_sum(list_transform(around, lambda x: len(regexp_extract_all(x, '{WORDS}')))) AS words,
  array_to_string(list_transform(around, lambda x, i: {_esc('x')} || coalesce('<|' || kinds[i] || '|>', '')), '') AS content FROM rows LEFT JOIN att USING (id))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content, sources)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, content, sources) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(END) + 1} + length(replace({_esc('role')}, chr(10), '&#10;')) + length(content)) AS BIGINT) AS formatted_chars,
  CAST(sum(words + coalesce(tokens, 0)) AS BIGINT) AS n_tokens, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_attachments,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS attachment_tokens,
  coalesce(string_agg(refs, chr(10) ORDER BY turn, role, content, sources) FILTER (n > 0), '') AS attachment_refs
FROM typed GROUP BY conv_id
"""
