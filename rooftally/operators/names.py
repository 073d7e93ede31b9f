"""Names of files and runs: parts by patterns, families by ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(name: Column, pattern: str, whole: bool = False) -> Column:
    """The first group of the pattern, null where it doesn't fit or the group is empty; ``whole``: it must begin at the name's beginning."""
    return F.nullif(F.regexp_extract(name, f"^(?:{pattern})" if whole else pattern, 1), F.lit(""))


def file_stem(path: Column) -> Column:
    """The last step of a path without what follows its last dot."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def family(run: Column, checkpoint: Column, rules: list[tuple[str, str]], other: str = "other", tagged: str | None = None, tags: dict[str, str] | None = None) -> Column:
    """The name of the first rule (pattern, name) that run and checkpoint, in lower case, fit; null ones are empty.

    A run that holds ``tagged`` is named by what follows its last underscore, if ``tags`` has it: such a tag says more than the folders around it.
    """
    low = F.lower(F.coalesce(run, F.lit("")))
    both = F.concat_ws(" ", low, F.lower(F.coalesce(checkpoint, F.lit(""))))
    named = reduce(lambda rest, r: F.when(both.rlike(r[0]), r[1]).otherwise(rest), reversed(rules), F.lit(other))
    if not tagged or not tags:
        return named
    tag = F.element_at(F.split(low, "_"), -1)
    told = F.element_at(F.create_map(*[F.lit(x) for pair in tags.items() for x in pair]), tag)
    return F.when(low.contains(tagged.lower()), F.coalesce(told, named)).otherwise(named)
