"""URL filter: pattern rules indexed by their rarest literal token.

A rule has a host, a path pattern (`*` stands for anything) and a verdict. It fits its host and all subdomains, where the
url's path starts with the pattern. The literal tokens of a rule (runs of ASCII letters and digits that cannot be part of a
longer run in a url that fits) are counted over all urls; the rarest becomes the rule's key. A url's tokens fetch the rules
under them, and only those run their regular expression. Of the rules that fit the longest wins, among equals the first in
order. Everything is DataFrame functions: few rules are one literal map that is looked up in place, without a shuffle; for
more, distinct urls are joined with the index by token.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; the verdict is then the default.
Repeated rows are judged each; other columns of the input, of whatever names, play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES

#: Rules up to this number are looked up in a literal map; more are joined.
INLINE_RULES = 256
_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path.removeprefix('/')}"

    @property
    def pattern(self) -> str:
        """Over host, a slash, which no host holds, and path."""
        path = ".*".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", part) for part in self.path.split("*"))
        host = re.sub(r"([^A-Za-z0-9])", r"\\\1", self.host)
        return rf"(?s)^(?:[^/]*\.)?{host}/{path}" if self.host else rf"(?s)^[^/]*/{path}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every url that fits holds as whole tokens."""
        found = re.findall(_TOKEN, self.host)
        for m in re.finditer(_TOKEN, self.path):
            around = self.path[m.start() - 1 : m.start()] or "/", self.path[m.end() : m.end() + 1] or "*"
            if "*" not in around:
                found.append(m.group())
        return list(dict.fromkeys(found))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat(host, F.lit("/"), path), F.lit(f"({_TOKEN})"), 1))


def token_counts(urls: DataFrame, tokens: list[str]) -> DataFrame:
    """In how many urls (rows with `tokens`) each of the given tokens occurs: partial sums, one row for each token."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    return urls.select(F.explode(F.array_intersect("tokens", wanted)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rarest(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules (by place) under the token of theirs that fewest urls hold; those without tokens under ''."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(key, []).append(i)
    return index


def _as_struct(i: int, rule: Rule) -> Column:
    return F.struct(F.lit(len(rule.host) + len(rule.path)).alias("length"), F.lit(-i).alias("place"), F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Rows (id, host, path, rule, verdict, n_candidates): the longest rule that fits, else a null rule and the default verdict."""
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    best = "struct<length:int,place:int,rule:string,verdict:string,pattern:string>"
    if not rules:
        urls = urls.withColumn("best", F.lit(None).cast(best)).withColumn("n_candidates", F.lit(0))
    else:
        tokens = sorted({t for r in rules for t in r.tokens})
        counts = {r["token"]: r["n"] for r in token_counts(urls, tokens).collect()} if tokens else {}  # a row for each rule token at most
        index = rarest(rules, counts)
        if len(rules) <= inline_rules:
            urls = _inline(urls, rules, index)
        else:
            urls = _joined(urls, rules, index)
    return urls.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), "n_candidates")


def _inline(urls: DataFrame, rules: list[Rule], index: dict[str, list[int]]) -> DataFrame:
    entries = [x for key, places in index.items() if key for x in (F.lit(key), F.array(*[_as_struct(i, rules[i]) for i in places]))]
    always = [_as_struct(i, rules[i]) for i in index.get("", [])]
    found = F.array(*always) if always else F.array().cast("array<struct<length:int,place:int,rule:string,verdict:string,pattern:string>>")
    if entries:
        literal = F.create_map(*entries)
        hits = F.filter(F.transform("tokens", lambda t: F.element_at(literal, t)), lambda x: x.isNotNull())
        found = F.concat(found, F.flatten(hits)) if always else F.flatten(hits)
    whole = F.concat("host", F.lit("/"), "path")
    urls = urls.withColumn("candidates", found)
    fit = F.filter("candidates", lambda c: F.call_function("rlike", whole, c["pattern"]))
    return urls.withColumn("n_candidates", F.size("candidates")).withColumn("best", F.array_max(fit))


def _joined(urls: DataFrame, rules: list[Rule], index: dict[str, list[int]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(key).alias("token"), _as_struct(i, rules[i]).alias("c")) for key, places in index.items() for i in places])
    known = urls.sparkSession.range(1).select(F.inline(rows))
    if sum(len(r.text) + len(r.pattern) + 64 for r in rules) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    distinct = urls.select("host", "path").distinct()
    asked = distinct.select("host", "path", F.explode(F.concat(url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    pairs = asked.join(known, "token")
    fits = F.call_function("rlike", F.concat("host", F.lit("/"), "path"), F.col("c.pattern"))
    judged = pairs.groupBy("host", "path").agg(F.max(F.when(fits, F.col("c"))).alias("best"), F.count("*").cast("int").alias("n_candidates"))
    return urls.join(judged, ["host", "path"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
