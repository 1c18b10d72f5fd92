"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of English, French, German and Spanish.
STOP_WORDS = "the and of to in is that for was with on be at by this are or an not de la le les et des en que un une est pour dans qui sur der die und das den zu von mit ist im nicht ein eine el los las y por con para del una se es".split()

# measure, comparison, bound; a document that breaks one line is rejected. Ratios are of words, characters or lines.
RULES: list[tuple[str, str, float]] = [
    ("n_words", ">=", 50),
    ("n_words", "<=", 1_000_000),
    ("mean_word_chars", ">=", 2),
    ("mean_word_chars", "<=", 20),
    ("symbol_ratio", "<=", 0.1),
    ("stop_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.5),
    ("repeat_ratio", "<=", 0.5),
    ("ellipsis_line_ratio", "<=", 0.5),
    ("bullet_line_ratio", "<=", 0.9),
]

SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row, however often body names it and wherever the optimizer puts it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column, n: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the row.

    The windows are hashed, sorted with their places, and neighbours compared; nothing is exploded or shuffled.
    """
    first = F.zip_with(F.slice(w, F.lit(1), n - 2), F.slice(w, F.lit(2), n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    third = F.zip_with(F.slice(w, F.lit(3), n - 2), F.sequence(F.lit(0), n - 3), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    # (window, place) in the windows' order; a text of fewer than four words has no two windows
    pairs = F.sort_array(F.zip_with(first, third, lambda x, y: F.struct(F.xxhash64(x["a"], x["b"], y["c"]).alias("h"), y["i"].alias("i"))))

    def covered(p: Column) -> Column:
        places = lambda x, y: F.array(*[z["i"] + k for z in (x, y) for k in range(3)])
        twice = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda x, y: F.when(x["h"] == y["h"], places(x, y)))
        return F.size(F.array_distinct(F.flatten(F.filter(twice, lambda z: z.isNotNull()))))

    return F.when(n < 4, F.lit(0)).otherwise(let(pairs, covered))


def measures(text: Column) -> Column:
    """struct of all measures of the whole text (null: no words, no lines)."""
    bare = lambda c: F.translate(c, " \t\n\x0b\x0c\r", "")
    starts = lambda x, *marks: F.lit(False) if not marks else F.ltrim(x).startswith(marks[0]) | starts(x, *marks[1:])

    def count(t: Column, w: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(bare(t)),
            "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w, F.size(w)),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: starts(x, "- ", "* ", "•"))),
        }
        return let(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]), ratios)

    def ratios(m: Column) -> Column:
        of = lambda top, bottom: F.when(m[bottom] > 0, m[top] / m[bottom]).otherwise(0.0)
        own = {"mean_word_chars": of("word_chars", "n_words"), "symbol_ratio": of("n_symbols", "word_chars"), "stop_ratio": of("n_stop_words", "n_words"), "dup_line_ratio": of("n_dup_lines", "n_lines"), "repeat_ratio": of("n_repeat_words", "n_words"), "ellipsis_line_ratio": of("n_ellipsis_lines", "n_lines"), "bullet_line_ratio": of("n_bullet_lines", "n_lines")}
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines")
        return F.struct(*[m[k].alias(k) for k in names], *[v.alias(k) for k, v in own.items()])

    words = lambda t: F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.length(bare(x)) > 0)
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: let(lines(t), lambda l: count(t, w, l))))


def verdict(m: Column, rules: list[tuple[str, str, float]] = RULES) -> Column:
    """The table as one boolean expression over the measures: true if every line holds."""
    out = F.lit(True)
    for measure, sign, bound in rules:
        out = out & (m[measure] >= bound if sign == ">=" else m[measure] <= bound)
    return out


def base_failed(m: Column) -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def quality(docs: DataFrame, text: str = "text", rules: list[tuple[str, str, float]] = RULES, out: str = "quality") -> DataFrame:
    """docs with struct column out: all measures, base_failed, and kept (not base_failed and the table holds).

    Null and empty texts have no words and fail. Repeated rows are judged alike; an empty table stays empty. A column of
    docs named out is replaced; all others are kept.
    """
    judged = let(measures(F.col(text)), lambda m: m.withField("base_failed", base_failed(m)).withField("kept", ~base_failed(m) & verdict(m, rules)))
    return docs.withColumn(out, judged)


def keep_good(docs: DataFrame, text: str = "text", rules: list[tuple[str, str, float]] = RULES) -> DataFrame:
    """The rows of docs that quality keeps, with the columns of docs."""
    return docs.where(let(measures(F.col(text)), lambda m: ~base_failed(m) & verdict(m, rules)))
