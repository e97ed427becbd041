r"""URL filters with redirect equivalence, natively on DataFrames.

A rule names a host and the start of a path, and fits that host and all its subdomains; of those that fit, the longest decides. Pages that
declare another address, by a canonical link or an immediate refresh, and addresses known to redirect are edges; what hangs together by edges is one
page under several names. A page that no rule fits is blocked if a rule blocks any of its names; a page that a rule allows stays allowed.

Addresses are compared without fragment, with scheme and host in lower case, an empty path as `/`, and `.` and `..` resolved. Links in HTML are
resolved against the page's url (a `<base>` is not heeded), `&amp;` in them is read as `&`, comments and scripts are skipped, and a tag ends at its first `>`.

Scale: one pass over the HTML yields a narrow table of edges, which is made distinct before anything joins it. The names are numbered in a
written table, so components are found on exact 64-bit ids by rounds of joins (`graph.components`) that gather no page's neighbours in one row. Pages that a rule
fits skip the last join; for the others the aliases are broadcast if their bytes, summed first, are few, else the join is shuffled and salted, so a url
that a third of all rows repeat is spread over tasks.

Edge cases: a null url, or one without `://`, has empty host and path, fits no rule, is in no component and is allowed; null HTML has no edges; links
that are no web address (`mailto:`) or name the page itself are none; repeated rows get equal results, a row each; empty tables give an empty result;
further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written
from tidemark.llm.graph import components

#: Bytes of a broadcast table of addresses, at most; and the salts of a shuffled join.
ALIAS_BYTES, SALTS = 16 << 20, 16
#: A policy is part of the plan, so it is short; longer lists belong in a table.
POLICY = 500


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; then what follows up to `?` or `#`. Both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host, path = (F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def ruling(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, of equally long ones the first; nulls where none does."""
    if not 0 < len(rules) <= POLICY:
        raise ValueError(f"a policy has 1 to {POLICY} rules")
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return name, verdict


def _without_dots(path: Column) -> Column:
    """A path with `.` and `..` resolved; left alone where it has none."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), joined).otherwise(path)


def address(url: Column) -> Column:
    """The name that a web address goes by here; null for what has no `://`."""
    host, path = host_and_path(url)
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), string.ascii_uppercase, string.ascii_lowercase)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(_without_dots(path)), query))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.replace(F.trim(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])), F.lit("&amp;"), F.lit("&"))


def declared(html: Column) -> Column:
    """array<string>: the links of a page's canonical tags and immediate refreshes, as written."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"(?i)<(?:link|meta)\s[^<>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike("(?i)^<link") & F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(tags, lambda t: t.rlike("(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
    to = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?i)^\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*['"]?\s*([^'"]+)""", 1))
    links = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(to, lambda u: F.trim(u)))
    return F.when(html.rlike("(?i)canonical|refresh"), links).otherwise(F.array().cast("array<string>"))  # most pages need no more than this look


def resolved(url: Column, link: Column) -> Column:
    """The address that `link` names on the page at `url`; null if it is none or the page's own."""
    host, path = host_and_path(url)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root, bare = F.concat(scheme, F.lit("://"), host), F.regexp_replace(link, r"(?s)#.*$", "")
    whole = (
        F.when(bare == "", None)
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(bare.rlike(r"(?i)^https?://[^/?#]"), bare))
        .when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .when(bare.startswith("?"), F.concat(root, path, bare))
        .otherwise(F.concat(root, F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)), bare))
    )
    return address(whole)


def page_edges(pages: DataFrame) -> DataFrame:
    """(here, there), distinct: addresses that the HTML of `pages` (url, html) says are one page."""
    links = pages.where("url is not null and html is not null").select("url", F.explode(declared(F.col("html"))).alias("link"))
    return links.select(address(F.col("url")).alias("here"), resolved(F.col("url"), F.col("link")).alias("there")).where("here <> there").distinct()


def blocked_names(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(address, blocked_by) for the addresses of `edges` (here, there) that no rule fits and that share a component with a blocked one: the smallest such."""
    edges = written(edges, "url-edges")
    names = edges.select(F.col("here").alias("address")).unionAll(edges.select("there")).distinct()
    names = written(names.withColumn("node", F.monotonically_increasing_id()), "url-names")  # the ids are fixed by the table
    ids = lambda end, to: names.select(F.col("address").alias(end), F.col("node").alias(to))
    rooted = components(edges.join(ids("here", "a"), "here").join(ids("there", "b"), "there").select("a", "b"))
    host, path = host_and_path(F.col("address"))
    name, verdict = ruling(host, path, rules)
    judged = names.join(rooted, "node").select("address", "root", name.alias("rule"), verdict.alias("verdict"))
    blocked = judged.where("verdict = 'block'").groupBy("root").agg(F.min("address").alias("blocked_by"))
    found = written(judged.where("rule is null").join(blocked, "root").select("address", "blocked_by"), "url-blocked")
    discard(edges)
    discard(names)
    discard(rooted)
    return found


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """For each row of `pages` (page_id, url, html): host, path, rule (its name or null), verdict (allow or block), blocked_by (the blocked alias, if that decided).

    `redirects` (from_url, to_url) adds edges known from elsewhere, such as the Location headers of a crawl.
    """
    edges = page_edges(pages)
    if redirects is not None:
        more = redirects.select(address(F.col("from_url")).alias("here"), address(F.col("to_url")).alias("there")).where("here <> there")
        edges = edges.unionAll(more).distinct()
    aliases = blocked_names(edges, rules)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = ruling(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), F.when(name.isNull(), address(F.col("url"))).alias("address"))
    ruled = rows.where("rule is not null").withColumn("blocked_by", F.lit(None).cast("string"))
    if (aliases.agg(F.sum(F.octet_length("address") + F.octet_length("blocked_by"))).first()[0] or 0) <= ALIAS_BYTES:
        others = rows.where("rule is null").join(F.broadcast(aliases), "address", "left")
    else:
        salted = aliases.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        salt = F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(SALTS))
        others = rows.where("rule is null").withColumn("salt", salt).join(salted, ["address", "salt"], "left").drop("salt")
    others = others.withColumn("verdict", F.when(F.col("blocked_by").isNull(), "allow").otherwise("block"))
    columns = ["page_id", "host", "path", "rule", "verdict", "blocked_by"]
    return ruled.select(*columns).unionAll(others.select(*columns))
