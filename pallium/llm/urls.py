"""URL filter by pattern rules (operator 7, DataFrame functions only).

Every rule becomes a regular expression and the literal tokens that any URL it
fits must hold whole. Rules are indexed by that token of theirs which is
rarest in the URL table at hand; a URL's tokens fetch candidate rules by an
equi-join, and only those rules' expressions are run.

Work is done once per distinct URL, so that a URL which a third of the pages
share costs as much as any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rule index is broadcast; more rules than this are refused.
MAX_RULES = 100_000
#: A token that every URL has: rules without a literal token are indexed by it.
ANY = ""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile("[0-9a-z]+")


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``.
    The longest fitting host rule decides, before any pattern rule."""

    action: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """A wildcard pattern over '.' + host + path; ``*`` stands for any text.
    Of fitting pattern rules the longest decides."""

    action: str
    pattern: str


# The host rules of the query.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
PATTERN_RULES = (
    PatternRule("block", "*.casino-*"),
    PatternRule("block", "*.adult-*"),
    PatternRule("block", "*.ads-*"),
    PatternRule("block", "*.ads.*"),
    PatternRule("block", "*-track.*"),
    PatternRule("block", "*/login/*"),
)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", lambda m: "\\" + m.group(1) if m.group(1).isascii() else m.group(1), text)


def compiled(rule: HostRule | PatternRule) -> tuple[str, list[str]]:
    """The rule's expression over '.' + host + path, and its whole literal
    tokens. A run of letters and digits that touches a wildcard or the open
    end of the rule may go on in a URL, so it is none."""
    if isinstance(rule, HostRule):
        literal = "." + rule.host.translate(str.maketrans(UPPER, LOWER)) + rule.path
        # The host part ends where the path begins, or at the end.
        expression = r"^(?:\.[^/]*)?" + _quoted(literal) + ("" if rule.path else r"(?![^/])")
        bounded = literal + ("" if rule.path else "/")
        parts = [bounded]
    else:
        parts = rule.pattern.split("*")
        expression = "(?s)^" + ".*".join(map(_quoted, parts)) + "$"
    tokens = set()
    for n, part in enumerate(parts):
        lowered = part.translate(str.maketrans(UPPER, LOWER))
        for m in _RUN.finditer(lowered):
            if m.start() > 0 and m.end() < len(lowered):
                tokens.add(m.group())
    return expression, sorted(tokens) or [ANY]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES,
          pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow",
          url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (the deciding host rule, else
    null) and ``verdict`` of every row; repeated rows and null ids are kept.

    A null URL or one without ``://`` has an empty host and path, which no
    host rule fits. Other columns are not read.
    """
    rules = [*host_rules, *pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, over the {MAX_RULES} that are broadcast")
    spark = pages.sparkSession
    rows = []
    for n, rule in enumerate(rules):
        fixed = isinstance(rule, HostRule)
        name = rule.host + rule.path if fixed else rule.pattern
        expression, tokens = compiled(rule)
        rows += [(n, fixed, name, rule.action, expression, token) for token in tokens]
    literals = spark.createDataFrame(
        rows, "rule_no int, fixed boolean, name string, action string, expression string, token string")

    asked = pages.select("page_id", F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    target = F.concat(F.lit("."), host_of(F.col("url")), path_of(F.col("url")))
    urls = asked.select("url").distinct().withColumn("target", target)
    runs = F.regexp_extract_all(F.translate("target", UPPER, LOWER), F.lit("[0-9a-z]+"), F.lit(0))
    tokens = urls.select("url", "target", F.explode(F.array_distinct(F.concat(runs, F.array(F.lit(ANY))))).alias("token"))

    known = F.broadcast(literals.select("token").distinct())
    frequency = tokens.join(known, "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = Window.partitionBy("rule_no").orderBy(F.coalesce("urls", F.lit(0)), "token")
    index = (literals.join(frequency, "token", "left").withColumn("place", F.row_number().over(rarest))
             .filter("place = 1").drop("place", "urls"))

    fits = tokens.join(F.broadcast(index), "token").filter(F.rlike("target", F.col("expression")))
    best = fits.groupBy("url").agg(
        F.max(F.struct("fixed", F.length("name").alias("size"), "name", "action")).alias("best"))
    judged = asked.join(best, "url", "left")
    return judged.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("best.fixed"), F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))
