"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs, as DataFrame functions.

A text is cut into sections at blank lines, sections into paragraphs at line ends, and paragraphs into pieces of up to eight
words. A piece's digest is that of its text; the digest of any other node is that of its children's digests in order, so roots are equal
exactly if texts are (but for collisions of the digests), and following differing digests downward locates an edit. The fingerprint
writes the tree: `root/section(paragraph.piece.piece,paragraph.piece);section(...)`, with the digests cut short.

To find each document's next one, only ids and digests are sorted and numbered. Texts are dealt by the key of id and digest,
rows of one key as one, and of each text as many first characters as the document before it needs travel on to that one's key.

Defined results: a null text is an empty text; equal texts have equal fingerprints, whatever their ids; documents are
in order of their ids, a null id first, and of the digests of their texts where ids are equal, so of rows that agree in both all but
one are followed by their like; the document after the last is the first, so a single document is its own next; texts of any length are
whole; an empty table gives none; other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, numbered

PIECE = r" *(?:[^ ]+ *){1,8}| +"
ROOT, INNER, LEAF = 32, 8, 6


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def fingerprint(text: Column) -> Column:
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), F.md5)
    over = lambda digests: F.md5(F.array_join(digests, ""))
    paragraph = lambda p: let(pieces(p), lambda leaves: F.struct(over(leaves).alias("d"), leaves.alias("of")))
    section = lambda s: let(
        F.transform(F.split(s, "\n"), paragraph), lambda ps: F.struct(over(F.transform(ps, lambda p: p["d"])).alias("d"), ps.alias("of"))
    )
    leaves = lambda of: F.array_join(F.transform(of, lambda x: F.concat(F.lit("."), F.left(x, F.lit(LEAF)))), "")
    paragraphs = lambda of: F.array_join(F.transform(of, lambda p: F.concat(F.left(p["d"], F.lit(INNER)), leaves(p["of"]))), ",")
    sections = lambda ss: F.array_join(
        F.transform(ss, lambda s: F.concat(F.left(s["d"], F.lit(INNER)), F.lit("("), paragraphs(s["of"]), F.lit(")"))), ";"
    )
    root = lambda ss: F.left(F.sha2(F.array_join(F.transform(ss, lambda s: s["d"]), ""), 256), F.lit(ROOT))
    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), lambda ss: F.concat(root(ss), F.lit("/"), sections(ss)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 if equal, else the share of distinct pieces that both have, of those of the one with more."""
    leaves = lambda f: F.array_distinct(F.regexp_extract_all(f, F.lit(rf"\.([0-9a-f]{{{LEAF}}})"), F.lit(1)))
    share = let(
        F.struct(leaves(a).alias("a"), leaves(b).alias("b")),
        lambda x: F.size(F.array_intersect(x["a"], x["b"])) / F.greatest(F.size(x["a"]), F.size(x["b"]), F.lit(1)),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def branches(a: Column, b: Column, digest: int) -> Column:
    """The children of two nodes that differ: (i, a, b), null where one side has none. Those that are alike from the front and from the back on are not
    looked into, so an insertion differs in what is inserted only; between them, children are paired in order."""
    alike = lambda x, y: F.equal_null(F.left(x, F.lit(digest)), F.left(y, F.lit(digest)))

    def ends(x: Column) -> Column:
        least = F.least(F.size(x["a"]), F.size(x["b"]))
        run = lambda same: F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.when((i > least) | ~same(i), i - 1)), lambda i: i.isNotNull())), least)
        front = run(lambda i: alike(F.get(x["a"], i - 1), F.get(x["b"], i - 1)))
        back = run(lambda i: alike(F.get(x["a"], F.size(x["a"]) - i), F.get(x["b"], F.size(x["b"]) - i)))
        return let(F.struct(front.alias("f"), back.alias("k"), least.alias("n")), lambda e: between(x, e["f"], F.least(e["k"], e["n"] - e["f"])))

    def between(x: Column, front: Column, back: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x["a"]), F.size(x["b"]))), lambda i: (i >= front) & (i < F.greatest(F.size(x["a"]), F.size(x["b"])) - back))
        child = lambda side, i: F.when(i < F.size(x[side]) - back, F.get(x[side], i))
        pairs = F.transform(places, lambda i: F.struct(i.alias("i"), child("a", i).alias("a"), child("b", i).alias("b")))
        return F.filter(pairs, lambda p: ~alike(p["a"], p["b"]))

    return let(F.struct(a.alias("a"), b.alias("b")), ends)


def edits(a: Column, b: Column) -> Column:
    """Where two texts with these fingerprints differ, as an array of (section, paragraph, piece, in_a, in_b): the trees are walked down from the roots
    along differing digests only. Places count from 0 in their parent; a piece that only one text has is not in the other. A blank paragraph
    has no piece: if that is the difference, piece is null."""
    split = lambda t, by: F.filter(F.split(F.coalesce(t, F.lit("")), by), lambda x: x != "")
    sections = lambda f: split(F.substring_index(f, "/", -1), ";")
    paragraphs = lambda s: split(F.regexp_extract(s, r"\((.*)\)", 1), ",")
    pieces = lambda p: split(F.substring(p, INNER + 1, 1 << 30), r"\.")
    none = F.lit(None).cast("int")
    place = lambda s, p, i, x: F.struct(s.alias("section"), p.alias("paragraph"), i.alias("piece"), x["a"].isNotNull().alias("in_a"), x["b"].isNotNull().alias("in_b"))

    def in_paragraph(s: Column, p: Column) -> Column:
        own = branches(pieces(p["a"]), pieces(p["b"]), LEAF)
        return let(own, lambda found: F.when(F.size(found) > 0, F.transform(found, lambda l: place(s["i"], p["i"], l["i"], l))).otherwise(F.array(place(s["i"], p["i"], none, p))))

    in_section = lambda s: F.flatten(F.transform(branches(paragraphs(s["a"]), paragraphs(s["b"]), INNER), lambda p: in_paragraph(s, p)))
    same_root = F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1)
    walked = F.flatten(F.transform(branches(sections(a), sections(b), INNER), in_section))
    return F.when(~same_root, walked).otherwise(F.array().cast("array<struct<section:int,paragraph:int,piece:int,in_a:boolean,in_b:boolean>>"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by as many first ones of the following text, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def followers(keys: DataFrame) -> DataFrame:
    """(key, prev_key, need, times) of keys (key, doc_id, h, n_chars, times): the key before each in order, how many characters of
    this text that one needs, and how many rows it stands for."""
    placed = numbered(keys, F.col("doc_id").asc_nulls_first(), F.col("h"), name="at")
    n = F.lit(max(1, placed.count()))
    before = placed.select(
        F.pmod(F.col("at") + 1, n).alias("at"), F.col("key").alias("prev_key"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"), F.col("times").alias("prev_times")
    )
    return as_table(placed.select("at", "key").join(before, "at").select("key", "prev_key", "need", "prev_times"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    rows = named.withColumn("key", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "h"))))
    keys = rows.select("key", "doc_id", "h", F.length("text").alias("n_chars")).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min("h").alias("h"), F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("times")
    )
    follow = followers(as_table(keys))
    # One column, so that both uses below read the same exchange of texts.
    once = rows.groupBy("key").agg(F.first(F.struct("doc_id", "text")).alias("row"))
    heads = once.join(follow, "key").select(
        F.col("prev_key").alias("key"), F.left(F.col("row.text"), F.col("need")).alias("head"), fingerprint(F.col("row.text")).alias("next_fingerprint"), F.col("prev_times").alias("times")
    )
    printed = once.select("key", "row.*").withColumn("fingerprint", fingerprint(F.col("text")))
    # Of rows that agree in id and text, all but one are followed by their like.
    half = F.floor(F.length("text") / 2).cast("int")
    nexts = F.array(
        F.struct("head", "next_fingerprint", F.lit(1).cast("long").alias("times")),
        F.struct(F.left(F.col("text"), half).alias("head"), F.col("fingerprint").alias("next_fingerprint"), (F.col("times") - 1).alias("times")),
    )
    paired = printed.join(heads, "key").withColumn("next", F.explode(F.filter(nexts, lambda x: x["times"] > 0)))
    followed = paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next.head")).alias("edited"),
        "fingerprint", F.col("next.next_fingerprint").alias("next_fingerprint"), F.col("next.times").alias("times"),
    )
    both = followed.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    found = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "times",
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "copy")
