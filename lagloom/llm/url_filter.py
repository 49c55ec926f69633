"""URL filters: rules indexed by the rarest token that every URL they match must hold.

A URL is cut into tokens, runs of letters and digits. Each rule is filed under one of its
literal tokens, the one that fewest URLs of the corpus hold; a URL's tokens fetch the rules
that may match, and only their regular expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 4096
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: A prefix rule: "host/path" fits the host and its subdomains where the path begins with the rule's.
PREFIX_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: A pattern rule: * stands for anything, ^ for a separator or the end, || for the start of a host or of a part of it.
PATTERN_RULES = [
    ("block", "||ads-track.*^"), ("block", "||ads.*^"), ("block", "||adserver.*^"), ("block", "||doubleclick.*^"), ("block", "||tracker.*^"),
    ("block", "/ads/*"), ("block", "/adserver/*"), ("block", "/banner/*"), ("block", "^popunder^"), ("block", "^phishing^"), ("block", "^malware^"),
    ("block", "^casino^"), ("block", "^porn^"), ("block", "^xxx^"),
]


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path. Both empty for null and for a text without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


def tokens_of(text: str) -> set[str]:
    return set(_TOKEN.findall(text.translate(_LOWER)))


@dataclass
class Rule:
    """kind prefix: text is host/path, matched against host + path. kind pattern: matched against the lower-cased URL."""

    verdict: str
    text: str
    kind: str
    tokens: list[str] = field(init=False)
    regex: re.Pattern = field(init=False)

    def __post_init__(self):
        if self.kind == "prefix":
            host, slash, path = self.text.partition("/")
            self.regex = re.compile(r"(?:[^/]*\.)?" + re.escape(host.translate(_LOWER) + slash + path) + ("" if slash else r"(?:/|\Z)"))
            # The path's last token may go on in the URL; all others stand whole.
            whole = self.text if not self.text or not self.text[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", self.text)
        else:
            own = self.text.translate(_LOWER)
            body = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in own.removeprefix("||"))
            self.regex = re.compile((r"[^/?#]*://(?:[^/?#]*\.)?" if own.startswith("||") else r".*?") + body, re.DOTALL)
            # At * and at an open end a token may go on.
            whole = own.replace("||", " ")
            whole = re.sub(r"[a-z0-9]*\*[a-z0-9]*", " ", whole)
            whole = re.sub(r"[a-z0-9]+$", "", whole) if own.startswith("||") else re.sub(r"^[a-z0-9]+|[a-z0-9]+$", "", whole)
        self.tokens = sorted(tokens_of(whole))

    def fits(self, address: str, url: str) -> bool:
        return self.regex.match(address if self.kind == "prefix" else url) is not None


class RuleIndex:
    """Rules by their rarest token. often: how many URLs hold a token; a token that none was counted for is rarest."""

    def __init__(self, rules: list[Rule], often: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, Rule]]] = {}
        self.always: list[tuple[int, Rule]] = []
        for n, rule in enumerate(rules):
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (often.get(t, 0), t)), []).append((n, rule))
            else:
                self.always.append((n, rule))

    def judge(self, url: str | None, default: str = "allow") -> tuple[str, str, str | None, str, str | None, int]:
        """host, path, prefix rule, verdict, pattern rule, and how many rules' expressions ran.

        Of prefix rules that fit the longest wins, of those as long the first. Without one, a
        pattern rule that fits gives the verdict, the first in the order of rules; without that, the default.
        """
        host, path = parts_of(url)
        if url is None:
            return host, path, None, default, None, 0
        low = url.translate(_LOWER)
        found = [*self.always, *(r for t in sorted(tokens_of(low)) for r in self.by_token.get(t, ()))]
        address = host + path
        fit = [(n, r) for n, r in sorted(found, key=lambda x: x[0]) if r.fits(address, low)]
        prefix = max((r for _, r in fit if r.kind == "prefix" and host), key=lambda r: len(r.text), default=None)
        pattern = next((r for _, r in fit if r.kind == "pattern"), None)
        verdict = prefix.verdict if prefix else pattern.verdict if pattern else default
        return host, path, prefix and prefix.text, verdict, pattern and pattern.text, len(found)


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many rows of urls (url) hold each of the tokens; the driver gets one number for each."""
    found = F.array_intersect(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), 1), F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))
    return {r.token: r.n for r in urls.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", column: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, pattern, tried of every row of pages; other columns are not read.

    A null URL has an empty host and path, no rule, and the default verdict; so has an empty one.
    Repeated rows have a row each; an empty table gives an empty result. rules are a parameter of the driver, broadcast with the task;
    tokens are counted over all rows first.
    """
    urls = pages.select(F.col(key).alias("key"), F.col(column).alias("url"))
    index = RuleIndex(rules, token_counts(urls, sorted({t for r in rules for t in r.tokens})))
    shared = pages.sparkSession.sparkContext.broadcast(index)
    names = ["key", "host", "path", "rule", "verdict", "pattern", "tried"]
    kinds = [pa.string()] * 5 + [pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = list(zip(*(shared.value.judge(u, default) for u in part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], names)

    kind = urls.schema["key"].dataType.simpleString()
    return urls.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, pattern string, tried int").withColumnRenamed("key", key)


def public_rules() -> list[Rule]:
    return [Rule(v, t, "prefix") for v, t in PREFIX_RULES] + [Rule(v, t, "pattern") for v, t in PATTERN_RULES]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), public_rules()).drop("tried")


def _pattern_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(low, '{'^' + r.regex.pattern.replace(chr(92) + '-', '-')}', 's') THEN '{r.text}'" for r in public_rules() if r.kind == "pattern")
    return f"CASE {cases} END"


def _rule_sql() -> str:
    longest = sorted(PREFIX_RULES, key=lambda r: -len(r[1]))
    cases = []
    for _, text in longest:
        host, _, path = text.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{text}'")
    return f"CASE {' '.join(cases)} END"


OP4_SQL = f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages
), p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u
), r AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, {_rule_sql()} AS rule, {_pattern_sql()} AS pattern FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({', '.join(f"'{t}'" for v, t in PREFIX_RULES if v == 'allow')}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM r
"""
