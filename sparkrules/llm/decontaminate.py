"""Benchmark decontamination: a broadcast set of n-grams, a scan of the documents, verified windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased. A window is ``WINDOW`` consecutive words of
an item; an item with fewer words, but not none, is one window. The scan cuts a document into aligned
chunks of ``CHUNK`` words. Every run of ``WINDOW`` words holds a whole chunk, so looking up one chunk in
five words among the item n-grams finds every possible hit; a found chunk brings its two neighbours along, and
the windows around it are compared as strings. Nothing but found chunks is shuffled. Items with fewer words are
looked up by their first word, from each word of a document.

The set goes to every executor only when it has at most ``tables.BROADCAST_ROWS`` rows; a larger one is joined
by a shuffle of hashed chunks.

Defined cases: a null or empty text has no words and no hits; an empty benchmark leaves all documents clean; rows that repeat a
``doc_id`` are judged each by its own text; a null ``doc_id`` is a value like any other; a benchmark row without id
makes hits but is in no item list; copies of an item count once per id. Other columns are never read by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.tables import body, lower_ascii, same, small
from sparkrules.storage import stored

WINDOW, CHUNK = 10, 5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of a text as it is
RUN = f"(?:[^ ]++ ){{1,{CHUNK}}}"
AHEAD = f"(?=((?:[^ ]++ ){{1,{WINDOW - 1}}}))[^ ]++ "


def spaced(text: Column) -> Column:
    """The words of a text, each followed by one blank."""
    joined = F.trim(F.regexp_replace(lower_ascii(text), GAP, " "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(joined, F.lit(" ")))


def item_windows(items: DataFrame) -> DataFrame:
    """``(item_id, gram, n)``: every window of every item, its words joined by blanks."""
    words = items.select("item_id", F.split(F.rtrim(spaced(body())), " ").alias("w")).filter("w[0] <> ''")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    grams = F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, WINDOW), " "))
    n = F.least(F.size("w"), F.lit(WINDOW))
    return words.select("item_id", n.alias("n"), F.explode(grams).alias("gram")).distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, a digest that tells texts of one id apart, and the text."""
    return docs.select("doc_id", F.md5(body()).alias("digest"), body().alias("text"))


def _long_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    long = windows.filter(F.col("n") == WINDOW).select("gram").distinct()
    at = F.sequence(F.lit(0), F.lit(WINDOW - CHUNK))
    parts = F.transform(at, lambda i: F.concat(F.array_join(F.slice(F.split("gram", " "), i + 1, CHUNK), " "), F.lit(" ")))
    chunks = stored(long.select(F.explode(parts).alias("chunk")).distinct())
    chunks = small(chunks.select(F.xxhash64("chunk").alias("key"), "chunk"))
    runs = docs.select("doc_id", "digest", F.regexp_extract_all(spaced(F.col("text")), F.lit(RUN), F.lit(0)).alias("mid"))
    zipped = F.arrays_zip("mid", F.concat(F.array(F.lit("")), "mid").alias("left"), F.slice("mid", 2, F.size("mid") + 1).alias("right"))
    runs = runs.select("doc_id", "digest", F.posexplode(zipped).alias("k", "run"))
    runs = runs.select("doc_id", "digest", "k", "run.left", "run.mid", "run.right").withColumn("key", F.xxhash64("mid"))
    found = runs.join(chunks, (runs["key"] == chunks["key"]) & (runs["mid"] == chunks["chunk"]), "inner")
    around = found.select(
        "doc_id",
        "digest",
        (F.greatest(F.col("k") - 1, F.lit(0)) * CHUNK).alias("first"),
        F.split(F.rtrim(F.concat("left", "mid", F.coalesce("right", F.lit("")))), " ").alias("w"),
    ).filter(F.size("w") >= WINDOW)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.array_join(F.slice("w", i + 1, WINDOW), " "))
    tried = around.select("doc_id", "digest", "first", F.posexplode(grams).alias("at", "gram"))
    return tried.select("doc_id", "digest", (F.col("first") + F.col("at")).alias("start"), F.lit(WINDOW).alias("n"), "gram")


def _short_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    short = windows.filter(F.col("n") < WINDOW).select("gram", "n").distinct()
    short = small(stored(short.select(F.substring_index("gram", " ", 1).alias("word"), "gram", "n")))
    ahead = F.regexp_extract_all(spaced(F.col("text")), F.lit(AHEAD), F.lit(1))
    words = docs.select("doc_id", "digest", F.posexplode(ahead).alias("start", "ahead"))
    words = words.withColumn("word", F.substring_index("ahead", " ", 1))
    found = words.join(short, "word").filter(F.expr("startswith(ahead, concat(gram, ' '))"))
    return found.select("doc_id", "digest", "start", "n", "gram")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document with a hit: ``doc_id, digest, n_hit, items`` (sorted as strings) and ``spans``.

    ``spans`` are the hit words as merged ``(start, end)`` word numbers, the end exclusive.
    """
    windows = stored(item_windows(items))
    docs = keyed(docs)
    found = _long_hits(docs, windows)
    if not windows.filter(F.col("n") < WINDOW).isEmpty():
        found = found.unionByName(_short_hits(docs, windows))
    found = found.join(small(windows.select("gram", "item_id")), "gram")
    per_doc = found.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("at"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    merged = F.aggregate(
        "at",
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["start"] + x["n"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end"))))),
    )
    per_doc = per_doc.select("doc_id", "digest", "items", merged.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return per_doc.select("doc_id", "digest", n_hit.alias("n_hit"), "items", "spans")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with ``n_words, n_hit, items, spans, contaminated``. Texts are not shuffled."""
    found = hits(docs, items)
    slim = docs.select("doc_id", F.md5(body()).alias("digest"), F.regexp_count(body(), F.lit(WORD)).cast("long").alias("n_words"))
    joined = slim.join(found, same(slim, found, "doc_id", "digest"), "left")
    return joined.select(
        slim["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, remove: str = "documents") -> DataFrame:
    """The documents, with their columns, without contaminated ones or (``remove="spans"``) without the hit words."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    found = small(stored(hits(docs, items).select("doc_id", "digest", "spans")))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.md5(body()).alias("digest"))
    on = same(rows, found, "doc_id", "digest")
    if remove == "documents":
        return rows.join(found, on, "left_anti").select("row.*")
    pieces = F.regexp_extract_all("row.text", F.lit(f"{WORD}|{WORD.replace('[^', '[', 1)}"), F.lit(0))
    offset = F.when(F.col("row.text").rlike(f"^{WORD}"), 0).otherwise(1)
    kept = F.filter(
        pieces,
        lambda _, i: ~F.exists("spans", lambda s: (F.floor((i - offset) / 2) >= s["start"]) & (F.floor((i - offset) / 2) < s["end"])),
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, ""))
    joined = rows.join(found, on, "left").select("row", text.alias("kept"))
    return joined.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
