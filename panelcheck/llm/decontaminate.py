"""Benchmark decontamination over a distributed positional inverted index.

A window is ten consecutive words of a benchmark item (a shorter item is one window).  For every window its rarest terms
are found by counting the item terms over the whole corpus.  The index stores the positions of these terms in every
training document.  A posting at position p of a term with offset k in the item votes for the diagonal p - k; the offset-adjusted lists
of a window intersect where all its rarest terms vote for one diagonal.  What is left is compared word by word with the document.

Proximity matches come from the same postings: every word of a window lies on one of ``slop`` + 1 diagonals in a row, but no diagonal of
them holds the whole window.  The rarest terms nominate cells of diagonals, and all words are then compared with the document.

DataFrame operations only.  The item table is broadcast while it is small (checked), and joined by shuffles beyond that;
postings never are.

Defined results: a null text has no words, on either side; a null item id is an item named by null and is
left out of the id list; equal items all count; repeated documents are rows of their own; empty tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck.llm.common import fresh, written

WINDOW = 10
RAREST = 2  # terms of a window that must meet on a diagonal
SLOP = 3
SMALL_TABLE = 100_000  # rows of an item-side table that may be broadcast (each under 100 bytes)
SMALL_KEYS = 1_000_000  # document keys (8 bytes each) that may be broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none.  Cutting at the gaps takes less than a quarter of the time of extracting word by word."""
    found = F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def small(df: DataFrame, rows: int | None = None, most: int = SMALL_TABLE) -> DataFrame:
    """The table, marked for broadcast if a count (of its rows or of what they hold) shows that it is small."""
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def item_words(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, item_id, item_words, len and n_windows of every item with words."""
    n = F.size("item_words")
    found = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("item_words")).filter(n > 0).distinct()
    return found.select(
        F.xxhash64("item_id", "item_words").alias("item"), "item_id", "item_words",
        F.least(n, F.lit(window)).alias("len"), F.greatest(n - window + 1, F.lit(1)).alias("n_windows"),
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, body and a key of both.  Equal rows share a key and so a result; words are compared in the end, so a chance
    meeting of two keys costs time but changes nothing."""
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return found.withColumn("key", F.xxhash64(F.col("id").cast("string"), "body"))


def tokens(docs: DataFrame) -> DataFrame:
    """(key, pos, term) of every document word."""
    return docs.select("key", F.posexplode(words(F.col("body"))).alias("pos", "term"))


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n): how often the whole corpus has each term of the items."""
    vocabulary = items.select(F.explode("item_words").alias("term")).distinct()
    return tokens(docs).join(small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """(term, item, off, votes): the places of items that some window has among its rarest terms, with a vote for each of those windows.

    A window takes ``rarest`` places of different terms where it has so many.
    A term that the corpus lacks rules its windows out.  A vote is the number
    start * (rarest + 1) + places, so that it says how many of its kind make the window complete.
    """
    placed = items.select("item", "len", "n_windows", F.posexplode("item_words").alias("off", "term"))
    known = placed.join(small(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = F.sequence(F.greatest(F.col("off") - F.col("len") + 1, F.lit(0)), F.least("off", F.col("n_windows") - 1))
    each = known.withColumn("start", F.explode(starts)).groupBy("item", "start", "term").agg(F.min("n").alias("n"), F.min("off").alias("off"))
    window = W.partitionBy("item", "start")
    ranked = each.withColumn("rank", F.row_number().over(window.orderBy("n", "term"))).withColumn("least", F.min("n").over(window))
    taken = ranked.filter((F.col("rank") <= rarest) & (F.col("least") > 0)).withColumn("places", F.count(F.lit(1)).over(window))
    vote = (F.col("start") * (rarest + 1) + F.col("places")).cast("int")
    return taken.groupBy("term", "item", "off").agg(F.collect_list(vote).alias("votes"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, at): the positions of the terms in every document, as a table in the shared folder."""
    postings = tokens(docs).join(small(terms), "term").groupBy("key", "term").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return written(postings, "postings")


def candidates(index: DataFrame, anchor: DataFrame, rarest: int, slop: int | None) -> DataFrame:
    """(key, item, near, diagonal, starts): windows whose rarest terms all vote for the diagonal, or (``near``) for the
    cell of 2 * (slop + 1) diagonals from it on.  Any slop + 1 diagonals in a row lie in one cell.

    Votes move once, by document and item; diagonals and cells are counted where they arrive.
    """
    by_term = anchor.groupBy("term").agg(F.collect_list(F.struct("item", "off", "votes")).alias("places"))
    cast = F.flatten(
        F.transform("places", lambda p: F.transform("at", lambda x: F.struct(p["item"].alias("item"), (x - p["off"]).alias("diagonal"), p["votes"].alias("votes"))))
    )
    met = index.join(small(by_term, anchor.count()), "term").select("key", F.explode(cast).alias("v")).select("key", "v.*").repartition("key", "item")
    place = lambda near, first: F.struct(F.lit(near).alias("near"), first.cast("int").alias("first"))
    places = [place(False, F.col("diagonal"))]
    if slop is not None:
        step = slop + 1
        low = F.floor(F.col("diagonal") / step) * step
        places += [place(True, low - step), place(True, low)]
    each = met.select("key", "item", "votes", F.inline(F.array(*places))).withColumnRenamed("first", "diagonal")
    votes = each.groupBy("key", "item", "near", "diagonal").agg(F.sort_array(F.flatten(F.collect_list("votes"))).alias("votes"))
    return votes.select("key", "item", "near", "diagonal", complete(F.col("votes"), rarest).alias("starts")).filter(F.size("starts") > 0)


def complete(votes: Column, rarest: int) -> Column:
    """The starts of windows with as many votes as they have places; ``votes`` are sorted, so equal ones follow one another."""
    at = lambda i: F.get(votes, i)
    first = lambda i: F.coalesce(at(i) != at(i - 1), F.lit(True))
    enough = lambda i: F.coalesce(at(i) == at(i + at(i) % (rarest + 1) - 1), F.lit(False))
    runs = F.filter(F.sequence(F.lit(0), F.size(votes) - 1), lambda i: first(i) & enough(i))
    return F.transform(runs, lambda i: F.floor(at(i) / (rarest + 1)).cast("int"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    rarest: int = RAREST,
    slop: int | None = SLOP,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_hit, n_items, items_sha256, contaminated, spans, n_near_items.

    ``spans`` are the exact matches as (item_id, first word, words), ``n_near_items`` counts the items with a proximity match;
    a ``slop`` of None leaves that column out.
    """
    result = compared(keyed(docs, id_col, text_col), items, item_id, item_text, window, rarest, slop)
    return result.withColumnRenamed("id", id_col).drop("key")


def compared(source: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, rarest: int, slop: int | None, every: bool = True) -> DataFrame:
    """The same for documents that have keys.  Without ``every``, only the documents with candidates: the texts of others stay where they are."""
    items = written(item_words(items, item_id, item_text, window), "benchmark-items")
    anchor = written(anchors(items, written(term_counts(source, items), "term-counts"), rarest), "anchors")
    found = written(candidates(build_index(source, anchor.select("term").distinct()), anchor, rarest, slop), "candidates")
    if not every:
        source = source.join(small(found.select("key").distinct(), most=SMALL_KEYS), "key", "left_semi")
    # an item's words once for each document that may hold it, however often it does
    per_item = found.groupBy("key", "item").agg(F.collect_list(F.struct("near", "diagonal", "starts")).alias("places"))
    named = per_item.join(items.select("item", "item_id", "item_words", "len"), "item")
    per_doc = named.groupBy("key").agg(F.collect_list(F.struct("item_id", "item_words", "len", "places")).alias("held"))

    def exact(c: Column, w: Column) -> Column:
        def at(p: Column) -> Column:
            place = lambda s: s + p["diagonal"]
            same = lambda s: F.when(place(s) >= 0, F.slice(w, F.greatest(place(s), F.lit(0)) + 1, c["len"]) == F.slice(c["item_words"], s + 1, c["len"])).otherwise(False)
            return F.transform(F.filter(p["starts"], same), lambda s: F.struct(c["item_id"].alias("item_id"), place(s).alias("first"), c["len"].alias("words")))

        return F.flatten(F.transform(F.filter(c["places"], lambda p: ~p["near"]), at))

    def near(c: Column) -> Column:
        """Whether some window of the item has all its words on slop + 1 diagonals in a row, none of which has it whole."""

        def at(s: Column, low: Column) -> Column:
            here = lambda k: F.slice("w", F.greatest(low + s + k, F.lit(0)) + 1, F.greatest(F.least(low + s + k, F.lit(0)) + slop + 1, F.lit(0)))
            every = F.forall(F.sequence(F.lit(0), c["len"] - 1), lambda k: F.array_contains(here(k), F.get(c["item_words"], s + k)))
            whole = lambda d: (d + s >= 0) & (F.slice("w", F.greatest(d + s, F.lit(0)) + 1, c["len"]) == F.slice(c["item_words"], s + 1, c["len"]))
            return F.when(every, ~F.exists(F.sequence(low, low + slop), whole)).otherwise(False)

        lows = lambda p: F.sequence(p["diagonal"], p["diagonal"] + slop + 1)
        return F.exists(F.filter(c["places"], lambda p: p["near"]), lambda p: F.exists(p["starts"], lambda s: F.exists(lows(p), lambda low: at(s, low))))

    n_near = F.lit(0) if slop is None else F.size(F.filter("held", near))
    read = source.join(per_doc.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").withColumn("w", words(F.col("body")))
    # the words are bound once for a document: a plain column used in one place would be worked out again for each start
    spans = F.get(F.transform(F.array("w"), lambda w: F.flatten(F.transform("held", lambda c: exact(c, w)))), 0)
    matched = read.select("id", "key", F.size("w").alias("n_words"), spans.alias("spans"), n_near.alias("n_near_items"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["words"] - 1))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["item_id"]), lambda i: i.isNotNull())))
    counted = matched.select("id", "key", "n_words", F.coalesce(F.size(hit), F.lit(0)).alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), "spans", "n_near_items")
    return counted.select(
        "key",
        "id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.greatest("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
        *([] if slop is None else [F.greatest(F.coalesce("n_near_items", F.lit(0)), F.lit(0)).cast("bigint").alias("n_near_items")]),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows and columns of the documents that hold no window of an item."""
    key, bad = fresh(docs, "document_key"), fresh(docs, "bad_key")
    judged = compared(keyed(docs, id_col, text_col), items, item_id, item_text, WINDOW, RAREST, None, every=False)
    found = small(written(judged.filter("contaminated").select(F.col("key").alias(bad)).distinct(), "contaminated"), most=SMALL_KEYS)
    marked = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")))
    return marked.join(found, F.col(key) == F.col(bad), "left_anti").drop(key)
