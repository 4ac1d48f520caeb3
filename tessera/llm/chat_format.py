"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (type, text, uri, units). A visitor turns them, in order, into one string: text is
escaped, an image, audio or document part becomes `<|type:k|>`, k counting the conversation's attachments from 1, and
`<|+|>` stands between two neighbouring texts. Each attachment is recorded with its reference, its units and the number of
tokens that its placeholder stands for (units, 1 for null, times the type's rate; 0 for a type without one).

Template: `<s>` then for each turn `<|start|>` role newline content `<|end|>` and a newline, then `</s>`. In roles, texts
and types `&`, `<` and `[` (with which every control string starts) become `&amp;` `&lt;` `&lsqb;`, in roles and types a
newline also `&nl;`, in types `|` and `:` also `&vert;` and `&colon;`. So no control string can come from the data, and
read_back() gives every turn and part exactly as it was: roles, types, texts, references and units.

The loss mask is a list of spans of the formatted string: the content of each assistant turn.

Defined results: null texts and roles are empty; a part of null type is a text; null parts are left out, null parts of a
turn are none; a null conv_id is a conversation of its own; turns are in order of turn (nulls first), ties by role, then by
the escaped texts and the attachments; repeated rows are repeated turns; no turns, no row; other columns are not read. A
conversation is one output string, so it is built in one task: its own size is the bound there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, FINISH, START, END, SEAM = "<s>", "</s>", "<|start|>", "<|end|>", "<|+|>"
#: Tokens for one unit: an image's unit is a tile, an audio's a second, a document's a page.
RATES = {"image": 256, "audio": 25, "document": 800}
PARTS = "array<struct<type:string,text:string,uri:string,units:double>>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_name(x: Column) -> Column:
    """A role or type: no line ends besides."""
    return F.replace(escape(x), F.lit("\n"), F.lit("&nl;"))


def unescape_name(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("&nl;"), F.lit("\n")))


#: A reference in a plain text, as Markdown writes it, and what its ending tells of the type; other endings are images.
REFERENCE = r"!\[[^\]\n]*\]\([^()\s]+\)"
ENDINGS = {"audio": r"(?i)\.(?:mp3|wav|ogg|flac)\)$", "document": r"(?i)\.(?:pdf|docx|txt)\)$"}


def parts_of(text: Column) -> Column:
    """The parts of a turn that is plain text: its references are attachments of one unit, with the whole reference as
    their uri, so joining texts and references gives the text back."""
    text = F.coalesce(text, F.lit(""))
    part = lambda kind, body, uri: F.struct(kind.alias("type"), body.alias("text"), uri.alias("uri"), F.lit(None).cast("double").alias("units"))
    none = F.lit(None).cast("string")
    kind = lambda r: F.coalesce(*[F.when(F.rlike(r, F.lit(p)), k) for k, p in ENDINGS.items()], F.lit("image"))
    gaps = F.transform(F.split(text, REFERENCE, -1), lambda g: part(F.lit("text"), g, none))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)), lambda r: part(kind(r), none, r))
    both = F.flatten(F.zip_with(gaps, found, lambda g, r: F.filter(F.array(g, r), lambda p: p.isNotNull())))
    return F.filter(both, lambda p: (p["type"] != "text") | (p["text"] != "") | (F.size(both) == 1))


def text_part(text: Column) -> Column:
    """One text part, the content of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("units")))


def formatted(turns: DataFrame, rates: dict[str, float] = RATES) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens); turns: (conv_id, turn, role, parts).

    loss_spans: array of (begin, length) in code points from 0. attachments: array of (number, turn, type, uri, units,
    tokens).
    """
    attached = lambda p: F.coalesce(p["type"] != "text", F.lit(False))
    rate = lambda p: F.coalesce(*[F.when(p["type"] == k, F.lit(float(v))) for k, v in rates.items()], F.lit(0.0))
    name = lambda p: F.replace(F.replace(escape_name(p["type"]), F.lit("|"), F.lit("&vert;")), F.lit(":"), F.lit("&colon;"))
    rows = turns.select(
        "conv_id", "turn", escape_name(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"),
        F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull()).alias("parts"),
    )
    # The visitor's first half: texts escaped, attachments counted. Ties of turn and role are in order of the texts.
    rows = rows.select(
        "conv_id", "turn", "role", "learn",
        F.transform("parts", lambda p: F.when(attached(p), F.lit(None)).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("texts"),
        F.transform(F.filter("parts", attached), lambda p: F.struct(
            p["type"].alias("type"), name(p).alias("name"), p["uri"].alias("uri"), p["units"].alias("units"), F.ceil(F.coalesce(p["units"], F.lit(1.0)) * rate(p)).cast("long").alias("tokens"),
        )).alias("att"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "texts", "att").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("att")).over(order), F.lit(0)).cast("int"))
    # Its second half: the k-th null among the texts is the k-th attachment.
    holder = lambda i: F.size(F.filter(F.slice("texts", 1, i + 1), lambda x: x.isNull()))
    seam = lambda i: F.when((i > 0) & F.get("texts", i - 1).isNotNull(), SEAM).otherwise("")
    mark = lambda i: F.concat(F.lit("<|"), F.get("att", holder(i) - 1)["name"], F.lit(":"), (F.col("first") + holder(i)).cast("string"), F.lit("|>"))
    content = F.array_join(F.transform("texts", lambda x, i: F.when(x.isNull(), mark(i)).otherwise(F.concat(seam(i), x))), "")
    # Nearly every turn is one text.
    plain = (F.size("texts") == 1) & (F.size("att") == 0)
    rows = rows.withColumn("content", F.when(plain, F.get("texts", F.lit(0))).otherwise(content))
    fixed = len(START) + 1 + len(END) + 1
    size = (fixed + F.length("role") + F.length("content")).cast("long")
    rows = rows.withColumn("at", len(BEGIN) + F.coalesce(F.sum(size).over(order), F.lit(0).cast("long")))
    begin = F.col("at") + len(START) + F.length("role") + 1
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "at", F.concat(F.lit(START), "role", F.lit("\n"), "content", F.lit(END + "\n")).alias("piece"), "learn",
        F.struct(begin.alias("begin"), F.length("content").cast("long").alias("length")).alias("span"),
        F.transform("att", lambda a, i: F.struct(
            (F.col("first") + i + 1).alias("number"), F.col("turn").alias("turn"), a["type"].alias("type"), a["uri"].alias("uri"), a["units"].alias("units"), a["tokens"].alias("tokens"),
        )).alias("att"),
    ))).alias("ts"))
    att = F.flatten(F.transform("ts", lambda t: t["att"]))
    return convs.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("ts", lambda t: t["piece"]), ""), F.lit(FINISH)).alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"), att.alias("attachments"),
        F.aggregate(att, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


#: What the visitor writes between the parts of one turn.
CONTROL = r"<\|(?:[^|:<]*:[0-9]+|\+)\|>"


def _parts(content: Column) -> Column:
    """The parts (type, text, uri, units) of a formatted content; the type and reference come from the attachments."""
    def attachment(mark: Column) -> Column:
        number = F.regexp_extract(mark, r":([0-9]+)\|>$", 1).cast("int")
        a = F.get("attachments", number - 1)
        return F.struct(a["type"].alias("type"), F.lit(None).cast("string").alias("text"), a["uri"].alias("uri"), a["units"].alias("units"))

    gaps, marks = F.split(content, CONTROL, -1), F.regexp_extract_all(content, F.lit(f"({CONTROL})"), F.lit(1))
    none, seam = F.lit(None), lambda i: F.coalesce(F.get(marks, i) == SEAM, F.lit(False))
    text = lambda g: F.struct(F.lit("text").alias("type"), unescape(g).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("units"))
    # An empty text beside an attachment is none; beside a seam, or alone, it is one.
    real = lambda g, i: (g != "") | seam(i) | ((i > 0) & seam(i - 1)) | (F.size(gaps) == 1)
    texts = F.transform(gaps, lambda g, i: F.when(real(g, i), text(g)))
    found = F.transform(marks, lambda m: F.when(m == SEAM, none).otherwise(attachment(m)))
    return F.filter(F.flatten(F.zip_with(texts, found, lambda g, a: F.array(g, a))), lambda p: p.isNotNull())


def joined(parts: Column) -> Column:
    """Parts as one text, an attachment as its reference."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["uri"], F.lit(""))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars, n_attachments, expanded_tokens), parsed from formatted: turns are (role,
    text, parts), text the parts joined() to one; loss_texts is what loss_spans cover, each span's parts joined(). A turn
    without parts reads back as one empty text."""
    body = F.substring("formatted", len(BEGIN) + 1, F.length("formatted") - len(BEGIN) - len(FINISH))
    pieces = F.split(body, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = lambda p: F.substring_index(p, "\n", 1)
    rest = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p))
    # Without attachments and seams a content is one text.
    whole = lambda c: F.when(F.contains(c, F.lit("<|")), joined(_parts(c))).otherwise(unescape(c))
    turns = F.transform(F.transform(pieces, lambda p: F.substring(p, len(START) + 1, F.length(p))), lambda p: F.struct(unescape_name(head(p)).alias("role"), whole(rest(p)).alias("text"), _parts(rest(p)).alias("parts")))
    texts = F.transform("loss_spans", lambda s: whole(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select(
        "conv_id", turns.alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )
