"""Fill-in-middle: a text is cut at two token edges and its pieces are told in another order.

A token is a word with the white space before it, or white space at the end. `regexp_count` gives
how many there are; a row's own pattern then holds two counted groups, ``unit{a}`` and
``unit{b-a}``, so one match captures prefix, middle and suffix and the replacement puts them
in order. Counts and the classes inside a unit are possessive: nothing is ever tried again, and
the matcher walks its counts in a loop, not by recursion, however long the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token; both branches take all they can.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Order of the pieces by form, as a replacement.
FORMS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
#: What finds the pieces again in an output of the form, and puts them back.
BACK = {"psm": (rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z", "$1$3$2"), "spm": (rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z", "$2$3$1")}


def draws(key: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2 ** 32 from the seed and the key's text; a null key is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(df: DataFrame, id_col: str, text_col: str, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """One row per input row: id, text (null ones as ''), n, form, output, prefix_chars, middle_chars (code points).

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first; both are drawn from seed and id, so copies
    of a row are treated alike, and rows of a null id too. A text that is null or empty or holds one of the three marks stays as it is: form ``plain``, output the text, counts
    null. Prefix, middle or suffix may be empty. Texts of any length are matched whole. Only id and text are read, so other columns can't clash; no rows give none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | held | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), (h1 % (F.col("n") + 1)).alias("_x"), (h2 % (F.col("n") + 1)).alias("_y"))
    a, b = F.least("_x", "_y").cast("string"), F.abs(F.col("_x") - F.col("_y")).cast("string")
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), a, F.lit(rf"}}+)((?:{UNIT}){{"), b, F.lit(r"}+)(.*)\z"))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, F.when(F.col("form") == "spm", FORMS["spm"]).otherwise(FORMS["psm"])))
    rows = rows.select("id", "text", "n", "form", output.alias("output"))
    # marks are no part of the text, so each is where it was put
    at = {m: F.instr("output", m) for m in (PREFIX, SUFFIX, MIDDLE)}
    start, stop = at[PREFIX] + len(PREFIX), F.when(F.col("form") == "spm", at[MIDDLE]).otherwise(at[SUFFIX])
    told = F.col("form") != "plain"
    return rows.select(
        "*", F.when(told, (stop - start).cast("long")).alias("prefix_chars"), F.when(told, (F.char_length("output") - at[MIDDLE] - len(MIDDLE) + 1).cast("long")).alias("middle_chars")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that `transformed` made ``output`` of; null if either is null."""
    back = {f: F.regexp_replace(output, *BACK[f]) for f in BACK}
    return F.when(form == "plain", output).when(form == "spm", back["spm"]).when(form == "psm", back["psm"])
