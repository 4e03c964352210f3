"""URL filter with redirect equivalence: rules by host and path, and block decisions that reach aliases.

A page is judged by the longest rule that fits its address. Where none fits, the page shares the fate of its
aliases: redirects and canonical links tie addresses together, connected components of those links are the classes of one
resource under many names, and a class in which a rule blocks any address is blocked as a whole. An own rule goes
first, so an address that is allowed explicitly stays allowed in a blocked class. A page without rule or blocked
alias is allowed.

Links come from the page itself (``<link rel=canonical>``, ``<meta http-equiv=refresh>``; not from comments, scripts or
styles) and from a table of redirects, if there is one. Relative targets are resolved against the page's address. Both
ends of a link take part, whether or not they are pages: a canonical address that a rule blocks takes its copies along.

Odd rows: an address that is null or has no ``://`` has empty host and path, no rule and no alias, so it is allowed.
Null and empty html have no links; malformed tags and targets with schemes of their own (``mailto:``) are no links; an
address that links to itself is its own alias only. Repeated pages are judged one by one, null ids like others. Of rules
with one host and path ``allow`` wins. An empty table gives an empty result. Only the named columns are read.

All of it is columns and joins. Rules are a parameter and are broadcast by host; links, components and aliases are never
collected; joins on addresses are salted (:mod:`ragspark.operators.hotkeys`), as one address may be most of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.components import components
from ragspark.operators.hotkeys import salted_join

#: Rules travel with the plan; a longer list is refused, as its broadcast would no longer be small.
MOST_RULES = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[ \t\n\x0B\f\r]"


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the path, A-Z in lower case; empty where there is no ``://``."""
    return F.coalesce(_lowered(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tidy(path: Column) -> Column:
    """A path without ``.`` and ``..``, starting with a slash."""
    steps = F.split(path, "/")

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    kept = F.aggregate(F.filter(steps, lambda s, i: (i > 0) | (s != "")), F.array().cast("array<string>"), walk)
    folder = F.element_at(steps, -1).isin(".", "..")
    tidied = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), tidied).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def with_address(frame: DataFrame, url: str, name: str) -> DataFrame:
    """Add ``name``, one spelling of an address: scheme and host in lower case, no ``.`` steps, no fragment.

    Null where there is no ``://``. Built in steps, so that no part is written into the plan more than once.
    """
    col = F.col(url)
    parts = frame.withColumns(
        {
            "__scheme": _lowered(F.substring(col, F.lit(1), F.instr(col, "://") - 1)),
            "__host": host_of(col),
            "__path": path_of(col),
            "__query": F.regexp_extract(_rest(col), r"^[^?#]*(\?[^#]*)", 1),
        }
    )
    whole = F.concat("__scheme", F.lit("://"), "__host", _tidy(F.col("__path")), "__query")
    made = F.when(F.col("__scheme") != "", whole)
    return parts.withColumn("__address", made).drop(name, "__scheme", "__host", "__path", "__query").withColumnRenamed("__address", name)


def with_target(frame: DataFrame, target: str, base: str, name: str) -> DataFrame:
    """Add ``name``, the address that ``target`` means on a page at ``base``; null where it is none or the base is none."""
    text = F.regexp_replace(F.col(target), f"^{_SPACE}+|{_SPACE}+$", "")
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    at = F.col(base)
    parts = frame.withColumns(
        {
            "__text": text,
            "__base": F.when(F.instr(at, "://") > 1, F.substring(at, F.lit(1), F.instr(at, "://") - 1)),
            "__site": host_of(at),
            "__from": path_of(at),
        }
    )
    text, site = F.col("__text"), F.concat("__base", F.lit("://"), "__site")
    folder = F.regexp_extract("__from", "^.*/", 0)
    whole = (
        F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text)
        .when(text.startswith("//"), F.concat("__base", F.lit(":"), text))
        .when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (text == "") | text.startswith("#"), F.lit(None).cast("string"))
        .when(text.startswith("/"), F.concat(site, text))
        .when(text.startswith("?"), F.concat(site, "__from", text))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), text))
    )
    found = parts.withColumn("__whole", whole).drop("__text", "__base", "__site", "__from")
    return with_address(found, "__whole", name).drop("__whole")


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare; empty where it is missing."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: addresses of pages and of what their canonical links and refreshes name.

    The patterns never look past the next ``<`` for the end of a tag, so their time is linear in the page.
    """
    body = F.col(html)
    shown = F.regexp_replace(body, r"(?s)<!--.*?(?:-->|\z)", " ")
    shown = F.regexp_replace(shown, r"(?is)<(script|style|textarea|title)\b.*?(?:</\1|\z)", " ")
    tags = F.regexp_extract_all(shown, F.lit(r"(?i)<(?:link|meta)\b[^<>]*>"), F.lit(0))
    tag = F.col("__tag")
    canonical = _attribute(tag, "rel").rlike(rf"(?i)(?:^|{_SPACE})canonical(?:{_SPACE}|$)")
    refresh = F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"
    to = (
        F.when(F.lower(F.substring(tag, 2, 4)) == "link", F.when(canonical, _attribute(tag, "href")))
        .when(refresh, F.regexp_extract(_attribute(tag, "content"), rf"""(?i)^[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    )
    named = (
        pages.filter(F.col(url).contains("://") & body.rlike("(?i)canonical|refresh"))
        .select(F.col(url).alias("source"), F.explode(tags).alias("__tag"))
        .select("source", to.alias("target"))
    )
    return redirect_links(named)


def redirect_links(redirects: DataFrame) -> DataFrame:
    """``a, b``: the addresses of ``source, target`` rows, a relative target being resolved against its source."""
    both = with_address(with_target(redirects.select("source", "target"), "target", "source", "b"), "source", "a")
    # a generator keeps the filter from being written into the plan with all that it filters
    return both.select(F.explode_outer(F.array(F.struct("a", "b"))).alias("link")).select("link.*").dropna()


def ruled(frame: DataFrame, rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """Add ``rule`` (host and path) and ``decision`` of the longest rule ``(verdict, host, path)`` that fits; null without one.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of one length that with the
    longer host wins. There is one broadcast lookup for each number of labels that a rule's host has.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if any(v not in ("allow", "block") or not h for v, h, _ in rules):
        raise ValueError("a rule is ('allow' or 'block', host, path)")
    by_host: dict[str, list[tuple]] = {}
    for verdict, name, start in sorted(set(rules)):
        found = (len(name) + len(start), len(name), verdict == "allow", start, name + start, verdict)
        by_host.setdefault(name.translate(str.maketrans(_UPPER, _LOWER)), []).append(found)
    kind = "array<struct<size: int, hostSize: int, allows: boolean, start: string, rule: string, decision: string>>"
    out, looked = frame, []
    for labels in sorted({name.count(".") + 1 for name in by_host}):
        some = [(name, found) for name, found in by_host.items() if name.count(".") + 1 == labels]
        column = f"__fits{labels}"
        table = frame.sparkSession.createDataFrame(some, f"__host{labels} string, {column} {kind}")
        deep = F.size(F.split(F.col(host), r"\.")) >= labels
        tail = F.when(deep, F.substring_index(F.col(host), ".", -labels))
        out = out.join(F.broadcast(table), tail == F.col(f"__host{labels}"), "left").drop(f"__host{labels}")
        looked.append(F.coalesce(F.col(column), F.array().cast(kind)))
    if not looked:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("decision", F.lit(None).cast("string"))
    best = F.array_max(F.filter(F.concat(*looked), lambda r: F.startswith(F.col(path), r["start"])))
    return out.withColumn("__best", best).select(*frame.columns, F.col("__best.rule").alias("rule"), F.col("__best.decision").alias("decision"))


def blocked_aliases(links: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``address``: every address in a component of ``links`` (``a, b``) that holds an address blocked by its own rule."""
    named = components(links)
    judged = ruled(named.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules)
    roots = judged.filter("decision = 'block'").select("root").distinct()
    return salted_join(named, roots, ["root"], "left_semi").select(F.col("node").alias("address"))


def judged(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    page_id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, decided_by`` (``rule``, ``alias`` or ``default``) for each page.

    ``redirects`` holds ``source, target`` addresses, as a crawler logs them; relative targets are resolved against the source.
    """
    links = None if html is None else page_links(pages, url, html)
    if redirects is not None:
        links = redirect_links(redirects) if links is None else links.union(redirect_links(redirects))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"))
    parts = own.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    # rows with a rule, or without an address, look nowhere
    looking = ruled(parts, rules).withColumn("__url", F.when(F.col("rule").isNull(), F.col("__url")))
    rows = with_address(looking, "__url", "address").drop("__url").fillna("", ["address"])
    if links is None:
        rows = rows.withColumn("__hit", F.lit(None).cast("boolean"))
    else:
        hits = blocked_aliases(links, rules).withColumn("__hit", F.lit(True))
        rows = salted_join(rows, hits, ["address"], spread=F.xxhash64("page_id"))
    return rows.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull(), F.col("decision")).when(F.col("__hit"), "block").otherwise("allow").alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("__hit"), "alias").otherwise("default").alias("decided_by"),
    )
