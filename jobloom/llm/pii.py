"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, payment cards and phone numbers that fixed patterns
find. A term that occurs in the documents of an entity gives it away as far as knowing the term tells of the entity:
with document counts n over N documents, the disclosure of entity e by term t is

    log2(n(e,t) * N / (n(e) * n(t))) / log2(N / n(e)),

the pointwise mutual information as a share of the entity's own information; 1 means that the term occurs with the
entity only. Terms at or above ``remove`` are removed, those at or above ``generalise`` replaced by their class,
wherever they stand in a document that holds the entity. A pair counts from SUPPORT documents on: fewer are no
estimate. All counts, those of pairs too, run over all documents and whole texts, the words inside entities included.

The patterns below are the ones of the contract, written so that Java neither backtracks over nor restarts inside a
run of characters that has already failed; each finds the same leftmost non-overlapping matches. Offsets are code
points, from the lengths of what lies between matches.

Edge cases: a null or empty text has no spans; the digest of no spans is that of the empty text; rows repeated in
full and null ids are told apart by their place; a number of both forms (card and phone) gives both spans. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import settled, small_or_joined, whole_text

#: Kinds in their order, with the pattern and a cheap test that any match passes.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
SUPPORT, REMOVE, GENERALISE = 3, 0.8, 0.6
TERM = "\\p{L}{3,}"


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(F.split(digits, "(?!^)(?=.)"))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of this kind counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(value, "\\.")
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _starts(pieces: Column, found: Column) -> Column:
    """Offsets of matches, from what lies before and between them."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.get(pieces, i))
        return F.struct((begin + F.length(F.get(found, i))).alias("at"), F.concat(acc["out"], F.array(begin)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, step)["out"]


def _words(text: Column) -> Column:
    """Hashes of the terms of a text, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), lambda w: F.xxhash64(F.lower(w)))


def _occurrences(text: Column, shown: Column) -> Column:
    """Places in a text of the terms that ``shown`` (term to disclosure) holds: array of (s, e, d)."""
    sized = lambda gap, w: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(w), F.lit(0)).alias("n"), F.try_element_at(shown, F.xxhash64(F.lower(w))).alias("d"))
    # The array is made once a text; what follows the last term has no term of its own.
    steps = F.zip_with(F.split(text, TERM), F.regexp_extract_all(text, F.lit(TERM), 0), sized)

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["gap"]
        place = F.struct(begin.alias("s"), (begin + t["n"]).alias("e"), t["d"].alias("d"))
        return F.struct((begin + t["n"]).alias("at"), F.when(t["d"].isNotNull(), F.concat(acc["out"], F.array(place))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,d:double>>").alias("out")), step)["out"]


def _mentions(kind: str, rank: int) -> Column:
    """From the columns found_ and starts_ of a kind: array of mentions."""
    found, starts = F.col(f"found_{kind}"), F.col(f"starts_{kind}")

    def mention(value: Column, i: Column) -> Column:
        start = F.get(starts, i)
        whole = F.struct(F.lit(rank).alias("rank"), start.alias("s"), (start + F.length(value)).alias("e"), F.xxhash64(F.lit(kind), F.lower(value)).alias("entity"))
        return F.when(_holds(kind, value), whole)

    return F.when(F.size(found) > 0, F.filter(F.transform(found, mention), lambda m: m.isNotNull())).otherwise(F.array().cast(MENTIONS))


MENTIONS = "array<struct<rank:int,s:int,e:int,entity:bigint>>"


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, mentions (by start, then kind) of every row, and the text of rows that have any."""
    read = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    for kind, pattern, sign in KINDS:
        found = F.regexp_extract_all("text", F.lit(pattern), 0)
        likely = F.contains("text", F.lit(sign)) if sign else F.col("text").rlike("[0-9][0-9\\x20-]{12}")
        read = read.withColumn(f"found_{kind}", F.when(likely, found).otherwise(F.array().cast("array<string>")))
    for kind, pattern, _ in KINDS:
        read = read.withColumn(f"between_{kind}", F.when(F.size(f"found_{kind}") > 0, F.split("text", pattern)))
    for kind, _, _ in KINDS:
        read = read.withColumn(f"starts_{kind}", F.when(F.size(f"found_{kind}") > 0, _starts(F.col(f"between_{kind}"), F.col(f"found_{kind}"))))
    listed = F.array_sort(F.concat(*(_mentions(kind, i).cast(MENTIONS) for i, (kind, _, _) in enumerate(KINDS))), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["rank"] - b["rank"]))
    return read.select("row_no", "doc_id", listed.alias("mentions"), "text").withColumn("text", F.when(F.size("mentions") > 0, F.col("text")))


def _document_counts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """h, n: in how many documents each wanted term occurs."""
    terms = F.array_distinct(_words(whole_text(text_col)))
    spread = docs.select(F.explode(terms).alias("h"))
    return spread.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(wanted, "h", "left_semi")


def _holders(found: DataFrame) -> DataFrame:
    """row_no, entity: every entity of a row once."""
    return found.filter(F.size("mentions") > 0).select("row_no", F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity"))


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """entity, h, disclosure: of every entity and term that occur together in at least ``support`` documents."""
    total = found.count()
    # A pair has at most the documents of its entity: only rows with an entity of so many can add to one that counts.
    entities = settled(_holders(found).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity").between(support, total - 1)))
    held = _holders(found).join(small_or_joined(entities), "entity", "left_semi").groupBy("row_no").agg(F.collect_list("entity").alias("entities"))
    listed = found.join(held, "row_no").select("entities", F.array_distinct(_words(F.col("text"))).alias("terms"))
    together = listed.select("entities", F.explode("terms").alias("h")).select(F.explode("entities").alias("entity"), "h")
    pairs = settled(together.groupBy("entity", "h").agg(F.count(F.lit(1)).alias("n_pair")).filter(F.col("n_pair") >= support))
    terms = _document_counts(docs, settled(pairs.select("h").distinct()), text_col).withColumnRenamed("n", "n_term")
    n = F.lit(float(total))
    shown = F.log2(F.col("n_pair") * n / (F.col("n_entity") * F.col("n_term"))) / F.log2(n / F.col("n_entity"))
    return pairs.join(small_or_joined(entities), "entity").join(terms, "h").select("entity", "h", shown.alias("disclosure"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """One row for each row of ``docs``: row_no, doc_id, base (array of rank, s, e), terms (array of s, e, removed)."""
    found = settled(mentions(docs, id_col, text_col))
    telling = settled(disclosures(docs, found, support, text_col).filter(F.col("disclosure") >= generalise))
    told = _holders(found).join(small_or_joined(telling), "entity").groupBy("row_no", "h").agg(F.max("disclosure").alias("d"))
    shown = told.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("h", "d"))).alias("shown"))
    inside = lambda t: F.exists("mentions", lambda m: (m["s"] < t["e"]) & (m["e"] > t["s"]))
    places = F.filter(_occurrences(F.col("text"), F.col("shown")), lambda t: ~inside(t))
    terms = F.when(F.col("shown").isNotNull(), F.transform(places, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), (t["d"] >= remove).alias("removed"))))
    base = F.transform("mentions", lambda m: F.struct(m["rank"].alias("rank"), m["s"].alias("s"), m["e"].alias("e")))
    none = F.array().cast("array<struct<s:int,e:int,removed:boolean>>")
    return found.join(shown, "row_no", "left").select("row_no", "doc_id", base.alias("base"), F.coalesce(terms, none).alias("terms"))


def _named(spans: Column) -> Column:
    """kind:start:end of (rank, s, e)."""
    kinds = F.array(*(F.lit(k) for k, _, _ in KINDS), F.lit("term"))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(kinds, m["rank"]), m["s"], m["e"])), ",")


def _counted(rank: int) -> Column:
    return F.size(F.filter("base", lambda m: m["rank"] == rank)).cast("long")


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts by kind, base_sha256, spans, n_removed, n_generalised."""
    spans = find_spans(docs, **options)
    more = F.transform("terms", lambda t: F.struct(F.lit(len(KINDS)).alias("rank"), t["s"].alias("s"), t["e"].alias("e")))
    every = F.array_sort(F.concat(F.col("base"), more), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["rank"] - b["rank"]))
    return spans.select(
        "doc_id",
        *(_counted(i).alias(f"n_{kind}") for i, (kind, _, _) in enumerate(KINDS)),
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(every).alias("spans"),
        F.size(F.filter("terms", lambda t: t["removed"])).cast("long").alias("n_removed"),
        F.size(F.filter("terms", lambda t: ~t["removed"])).cast("long").alias("n_generalised"),
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and the text with entities and generalised terms replaced by their class, removed terms by nothing.

    Of overlapping spans the one that begins first is replaced, and what others add behind it is cut away. Spans and
    texts meet by id, which must be unique.
    """
    spans = find_spans(docs, id_col, text_col, **options)
    names = F.array(*(F.lit(f"<{k}>") for k, _, _ in KINDS))
    marked = F.concat(
        F.transform("base", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.get(names, m["rank"]).alias("by"))),
        F.transform("terms", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.when(t["removed"], "").otherwise("<term>").alias("by"))),
    )
    plan = spans.select(F.col("doc_id").alias("_id"), F.array_sort(marked).alias("_spans"))
    text = whole_text(text_col)

    def step(acc: Column, m: Column) -> Column:
        new = F.concat(acc["out"], text.substr(acc["at"] + 1, m["s"] - acc["at"]), m["by"])
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.when(m["s"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    joined = docs.select(F.col(id_col), F.col(text_col)).join(plan, F.col(id_col).eqNullSafe(F.col("_id")))
    done = F.aggregate("_spans", start, step)
    return joined.withColumn("_done", done).select(F.col(id_col), F.concat(F.col("_done.out"), text.substr(F.col("_done.at") + 1, F.length(text))).alias(text_col))
