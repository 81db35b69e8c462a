"""URL verdicts by rules, and redirect equivalence for urls that no rule decides.

A rule names a host (and so its subdomains) and the beginning of a path; the longest fitting
rule wins. Redirects and canonical links make urls aliases of each other. Aliases form connected
components, and a url without a rule is judged by its component: allowed if any alias has an
explicit allow, else blocked if any alias is blocked, else allowed.
"""

from __future__ import annotations

import re
import string
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import known, saved, slices
from tessera.llm.components import components

#: (rule as host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_TAG = re.compile(r"<(?:link|meta)\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_REFRESH = re.compile(r"""^\s*[\d.]*\s*[;,]\s*url\s*=\s*['"]?([^'"]+)""", re.I)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.split(rest, "[/?#]", 2)[0]
    path = F.split(F.substring(rest, F.length(host) + 1, F.length(rest)), "[?#]", 2)[0]
    return (F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit("")))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null; of equally long ones an allow goes first."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def verdict_of(rule: Column, rules=RULES) -> Column:
    """A rule's verdict; null without a rule."""
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def node(url: Column) -> Column:
    """The name under which a url takes part in links: without fragment, scheme and host in
    lower case; null for a null url or one without ``://``."""
    bare = F.split(url, "#", 2)[0]
    front = F.regexp_extract(bare, "^[^/?]*://[^/?]*", 0)
    return F.when(front != "", F.concat(F.translate(front, string.ascii_uppercase, string.ascii_lowercase),
                                        F.substring(bare, F.length(front) + 1, F.length(bare))))


def targets(url: str, html: str) -> list[str]:
    """Where a page's canonical links and refreshing redirects point."""
    out = []
    low = html.lower()
    if "canonical" not in low and "refresh" not in low:
        return out
    for tag in _TAG.findall(html):
        a = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(tag)}
        if tag[1:5].lower() == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            out.append(a["href"].strip())
        elif a.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(a.get("content", ""))):
            out.append(m[1].strip())
    found = []
    for t in out:
        try:
            found.append(urljoin(url, t.replace("&amp;", "&")))
        except ValueError:  # no url
            continue
    return found


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the pages' canonical links and redirects."""

    def run(batches):
        for s in slices(batches):
            got = [(u, t) for u, h in zip(s.column(0).to_pylist(), s.column(1).to_pylist()) if u and h for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())],
                                             ["from_url", "to_url"])

    return known(pages, url="string", html="string").mapInArrow(run, "from_url string, to_url string")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, and component (the smallest
    alias; null for a page without aliases).

    redirects: further (from_url, to_url) pairs. A null url has no host, path, rule or alias and
    is allowed; null ids stay null; repeated rows are judged each; further columns are ignored;
    an empty table gives no rows. Only the verdict counts of components are joined back, by
    url, and only for urls with links; a hot url is split by AQE.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.union(known(redirects, from_url="string", to_url="string"))
    links = saved(links.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")), "alias-links")
    part = components(links, "alias")
    every = part.union(part.select("component", "component")).distinct().toDF("node", "component")
    host, path = host_and_path(F.col("node"))
    stated = every.withColumn("v", verdict_of(rule_for(host, path, rules), rules))
    whole = stated.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    inherited = saved(every.join(whole, "component").select(
        "node", "component", F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("allow").alias("inherited")), "alias-verdicts")
    host, path = host_and_path(F.col("url"))
    p = known(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node")) \
        .withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    return p.join(inherited, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), "inherited", F.lit("allow")).alias("verdict"), "component")
