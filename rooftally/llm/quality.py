"""Quality rules, lines first: failing lines go, then documents that lose too much text.

All of it is built-in expressions over one row, so a scan is the whole plan. Windows of
words repeated inside a text are found by sorting the text's own window digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.llm.text import SPACE, WORD, bind, word_count, words_by

#: Phrases of page furniture, in lower case, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "click here", "read more",
    "sign up", "log in", "subscribe to our", "share this", "skip to content", "enable javascript", "lorem ipsum", "licensed under",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "weiterlesen", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "cliquez ici", "lire la suite", "se connecter", "abonnez-vous", "aller au contenu",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aceptar cookies", "haga clic aquí", "leer más", "iniciar sesión", "suscríbete", "saltar al contenido",
)
#: Whole words only: in a longer word, as "log in" in "catalog index", there is no phrase. One for each so many words of a line, or more, make it furniture.
FURNITURE = rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(BOILERPLATE)})($|[^\p{{L}}\p{{N}}])"
PER_WORDS = 8
#: A line of fewer words needs punctuation at its end; a longer one without any punctuation inside fails from RUN_ON words on.
STUB, RUN_ON = 3, 100
#: Separators of menus and tables.
NAVIGATION = r"\||»|›|•|·| > "


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array."""

    def of(digests: Column) -> Column:
        rows = F.array_sort(F.transform(digests, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))

        def places(r: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(r, k)["d"] == x["d"], F.lit(False))
            return F.array_sort(F.transform(F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            lengths = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
            return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(digests)) == F.size(digests), F.lit(0).cast("long")).otherwise(bind(bind(rows, places), covered))

    def windows(hashes: Column) -> Column:
        ids = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
        return F.when(F.size(hashes) < width, F.array().cast("array<bigint>")).otherwise(ids)

    return bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), of)


def failing_line(line: Column) -> Column:
    """A rule on one line that has a word: navigation, symbols for punctuation, furniture, punctuation that is missing.

    Furniture is counted against the line's words, so a paragraph that holds a phrase stays.
    """
    n = word_count(line)
    navigation = F.regexp_count(line, F.lit(NAVIGATION))
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>]|!!"))
    stub = (n < STUB) & ~F.rlike(line, F.lit(r"[.!?:;,…\"”»)\]][\x20\x09-\x0D]*$"))
    run_on = (n >= RUN_ON) & ~F.rlike(line, F.lit(r"[.!?:;,…。！？]"))
    furniture = F.regexp_count(F.lower(line), F.lit(FURNITURE))
    return ((navigation >= 3) & (navigation * 4 >= n)) | ((marks >= 3) & (marks * 4 >= n)) | ((furniture > 0) & (furniture * PER_WORDS >= n)) | stub | run_on


def quality(df: DataFrame, id_col: str, text_col: str, min_words: int = 20, repeat_percent: int = 30, lost_percent: int = 50) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, n_lines_removed, clean_text, kept.

    A line with a word goes if a rule fails it, or if it equals an earlier line. A document is
    kept if the base doesn't fail it and its lines that stay hold over ``100 - lost_percent``
    of its word characters. Null and empty texts have no words, fail and have an empty clean
    text. Rows are independent: repeated rows give equal rows, an empty table none. Only id and text are read, so other columns can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    has_word = lambda x: F.rlike(x, F.lit(WORD))
    bare = lambda x: F.char_length(F.regexp_replace(x, SPACE, ""))

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, has_word)
        distinct = F.array_distinct(worded)
        stay = F.filter(distinct, lambda x: ~failing_line(x))
        return bind(stay, lambda s: F.struct(
            (F.size(worded) - F.size(distinct)).cast("long").alias("n_dup_lines"),
            (F.size(worded) - F.size(s)).cast("long").alias("n_lines_removed"),
            F.array_join(s, "\n").alias("clean_text"),
        ))

    rows = rows.select(
        "id", word_count(F.col("text")).alias("n_words"), bare(F.col("text")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(F.split("text", "\n", -1), of_lines).alias("l"),
        repeated_words(words_by(F.col("text"), SPACE)).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = rows.select("id", "n_words", "word_chars", "n_symbols", "l.n_dup_lines", "n_repeat_words", base.alias("base_failed"), "l.n_lines_removed", "l.clean_text")
    enough = bare(F.col("clean_text")) * 100 > F.col("word_chars") * (100 - lost_percent)
    return rows.withColumn("kept", ~F.col("base_failed") & enough)
