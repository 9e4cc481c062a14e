"""Fill-in-middle transformation in Spark SQL functions: texts are cut in three by a hash of their id and rearranged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A run of letters or any other code point.
UNIT_PATTERN = "[A-Za-z]+|[^A-Za-z]"
_SENTINELS = "<[PSM]>"


def hash_parts(id_column: Column, seed: str, parts: int = 4) -> list[Column]:
    """Unsigned numbers from 8-digit groups of the sha256 of the seed, a colon and the id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(parts)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", changed_percent: int = 90, suffix_first_percent: int = 20) -> DataFrame:
    """All columns and n, form (plain, psm or spm), prefix, middle, suffix and output.

    A text is matched left to right as units, runs of letters A-Z or single code points. The smaller and the larger of
    two hash places among its n + 1 gaps end the prefix and the middle. psm writes prefix, suffix and middle, each
    behind its sentinel, and spm the suffix before the prefix; the form follows two more parts of the hash. Everything
    is made within a row, whole texts, no shuffle.

    Null text is the empty one. Empty texts, and texts that hold a sentinel, stay plain: the output is the text, and
    prefix, middle and suffix are null. Null ids hash as the empty id and keep their row; equal ids are cut by the same
    numbers; repeated rows come out alike. Columns of the result's names are replaced. No rows give no rows.
    """
    new = ["n", "form", "prefix", "middle", "suffix", "output"]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    h1, h2, h3, h4 = hash_parts(docs[id_col], seed)
    kept = [docs[c] for c in docs.columns if c not in new]
    units = docs.select(*kept, text.alias("__t"), h1.alias("__h1"), h2.alias("__h2"), h3.alias("__h3"), h4.alias("__h4"), F.regexp_extract_all(text, F.lit(UNIT_PATTERN), 0).alias("__u"))
    gaps = F.size("__u") + 1
    sentinel = F.contains("__t", F.lit(PREFIX)) | F.contains("__t", F.lit(SUFFIX)) | F.contains("__t", F.lit(MIDDLE))
    plain = (F.col("__t") == "") | sentinel | (F.col("__h3") % 100 >= changed_percent)
    names = [c for c in docs.columns if c not in new]
    cut = units.select(
        *names,
        "__t",
        "__u",
        F.size("__u").cast("long").alias("n"),
        F.when(plain, "plain").when(F.col("__h4") % 100 < suffix_first_percent, "spm").otherwise("psm").alias("form"),
        F.least(F.col("__h1") % gaps, F.col("__h2") % gaps).cast("int").alias("__a"),
        F.greatest(F.col("__h1") % gaps, F.col("__h2") % gaps).cast("int").alias("__b"),
    )
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("__u", start, length), ""))
    parts = cut.select(
        *names,
        "__t",
        "n",
        "form",
        piece(F.lit(1), F.col("__a")).alias("prefix"),
        piece(F.col("__a") + 1, F.col("__b") - F.col("__a")).alias("middle"),
        piece(F.col("__b") + 1, F.size("__u") - F.col("__b")).alias("suffix"),
    )
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("__t"))
    return parts.withColumn("output", output).drop("__t")


def restored(output: Column, form: Column) -> Column:
    """The text of an output, by its sentinels and form alone; null where the parts that the form tells are not there."""
    parts = F.split(output, _SENTINELS, -1)
    at = lambda i: F.get(parts, F.lit(i))
    text = F.when(form == "plain", output)
    text = text.when((form == "psm") & output.startswith(PREFIX) & (F.size(parts) == 4), F.concat(at(1), at(3), at(2)))
    return text.when((form == "spm") & output.startswith(SUFFIX) & (F.size(parts) == 4), F.concat(at(2), at(3), at(1)))
