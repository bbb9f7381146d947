"""URL filters: pattern rules found through their rarest literal token, then checked by regular expression.

A URL is cut into tokens. Every rule is filed under one literal token that any URL it matches must hold: the one
that is rarest among all URLs given. A URL's tokens fetch its candidate rules by an equi-join, and only those
run their expression. Rules without such a token are filed under the empty token, which every URL has.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import lower_ascii, staged

#: What a host rule allows and blocks, as the query's contract fixes it: host/path, action.
HOST_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

#: Default patterns for URLs without a host rule: ``*`` any characters, ``^`` a character that is no letter, digit, ``_``, ``-``, ``.`` or ``%``
#: (or the end), a leading ``|`` the start of the URL. The longest that matches decides; without any, the URL is allowed.
PATTERNS = [
    ("^ads^", "block"), ("^adserver^", "block"), ("^banner^", "block"), ("^track^", "block"), ("^click^", "block"), ("^redirect^", "block"),
    ("^login^", "block"), ("^signin^", "block"), ("^cart^", "block"), ("^checkout^", "block"), ("^casino^", "block"), ("^poker^", "block"),
    ("^porn^", "block"), ("^xxx^", "block"), ("^sex^", "block"), ("^torrent^", "block"), ("^cgi-bin^", "block"), ("^wp-admin^", "block"),
    ("^search^*q=", "block"), ("^tag^*page=", "block"), ("|ftp:", "block"),
]

TOKENS = "[a-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else f"\\{c}" for c in literal)


def _low(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def _safe_tokens(literal: str, open_left: bool, open_right: bool) -> list[str]:
    """Tokens that stand whole in every URL holding ``literal``: bounded inside it, or at a closed end."""
    low = _low(literal)
    return [m.group() for m in re.finditer(TOKENS, low) if (m.start() > 0 or not open_left) and (m.end() < len(low) or not open_right)]


def compile_host_rule(rule: str) -> tuple[str, list[str]]:
    """Expression over ``host/path`` (a host holds no slash) and literal tokens of a rule ``host/path``: that host and its subdomains, that path prefix."""
    host, slash, path = rule.partition("/")
    host = _low(host)
    return rf"^(?:[^/]*\.)?{_quoted(host)}/{_quoted(slash + path)}", _safe_tokens(host, False, False) + _safe_tokens(slash + path, False, True)


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """Expression over the lower-cased URL and literal tokens of a wildcard pattern."""
    start = pattern.startswith("|")
    body = _low(pattern[start:])
    out, tokens, open_left = ["^" if start else ""], [], not start
    pieces = re.split(r"([*^])", body)
    for i, piece in enumerate(pieces):
        if piece == "*":
            out.append(".*")
            open_left = True
        elif piece == "^":
            out.append(r"(?:[^\w.%-]|\z)" if i and any(pieces[:i]) else r"(?:^|[^\w.%-])")
            open_left = False
        elif piece:
            out.append(_quoted(piece))
            tokens += _safe_tokens(piece, open_left, not (i + 1 < len(pieces) and pieces[i + 1] == "^"))
            open_left = True
    return "(?s)" + "".join(out), tokens


def rule_table(spark: SparkSession, host_rules: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """rule, action, tier (1 host rules, 0 patterns), size, expression, tokens. A frame, so that rules may be any number."""
    rows = [(r, a, 1, len(r), *compile_host_rule(r)) for r, a in host_rules] + [(p, a, 0, len(p), *compile_pattern(p)) for p, a in patterns]
    return spark.createDataFrame(rows, "rule string, action string, tier int, size int, expression string, tokens array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    Equal URLs are judged once, however many pages carry them, and only URLs are shuffled, never other columns of a page
    apart from the last join. Host rules decide before patterns, the longest rule wins, equal lengths go by rule text.
    ``rule`` names a host rule or is null. Null URLs and URLs without ``://`` have empty host and path; null takes ``default``.
    The rules are joined by token like any table: Spark broadcasts them while they are small and shuffles them beyond that.
    """
    text = F.col(f"`{url}`").cast("string")
    urls = pages.where(text.isNotNull()).select(text.alias("u")).distinct()
    literal = rules.select("rule", "tier", F.explode("tokens").alias("token"))
    of_rules = literal.select("token").union(rules.where(F.size("tokens") == 0).select(F.lit("").alias("token"))).distinct()
    own = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("u")), F.lit(f"({TOKENS})"), 1))
    tokens = urls.select("u", F.explode(F.array_union(F.array(F.lit("")), own)).alias("token"))
    tokens = staged(tokens.join(of_rules, "token", "left_semi"), "url-tokens")  # tokens that no rule has go at once
    seen = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(seen, "token", "left").groupBy("rule", "tier").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    filed = rules.join(rarest, ["rule", "tier"], "left").select("rule", "action", "tier", "size", "expression", F.coalesce("token", F.lit("")).alias("token"))
    filed = staged(filed, "url-rules")
    subject = F.when(F.col("tier") == 1, F.concat(host_of(F.col("u")), F.lit("/"), path_of(F.col("u")))).otherwise(lower_ascii(F.col("u")))
    fits = tokens.join(filed, "token").where(F.rlike(subject, F.col("expression")))
    order = F.struct("tier", "size", F.col("rule"))
    best = fits.groupBy("u").agg(F.max_by(F.struct("rule", "tier", "action"), order).alias("best"))
    out = pages.withColumn("__u", text).drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url])
    out = out.join(best.withColumnRenamed("u", "__u"), "__u", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in out.columns if c not in ("__u", "best")],
        host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path"),
        F.when(F.col("best.tier") == 1, F.col("best.rule")).alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
