"""Main text of web pages by deducing each host's template from equivalence classes of markup and text tokens.

A token is an element or a word of text with its role: the path of elements that hold it, with classes and ids. On the
pages of a host, tokens that occur equally often on every page share an occurrence vector and form an equivalence class.
Classes with elements that most of the host's pages hold are valid; nested by their paths they make the template. A word
belongs to the template if an element that holds it is in its class. An element's slot is variable unless all of its
words belong to the template; the variable slots of the innermost element of the outermost class that has most of the
variable text are the article. Names of tags and classes only serve where the classes can't tell: see ``extract``.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scratch

_aside = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_strict = re.compile(_aside + r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_loose = re.compile(_aside + r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)  # quotes do not matter
_rest = re.compile(_aside + r"|(\b\B)?(\b\B)?(\b\B)?(?:[^<]+|<)", re.S)  # where no tag can end any more; the groups are empty
_opens = re.compile(r"</?[A-Za-z]")
_named = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_split = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that never hold an article's text.
SKIPPED = frozenset("head nav footer aside form script style noscript template iframe svg math button select option textarea dialog menu object canvas audio video noembed noframes title".split())
#: Words of classes, ids and roles that say the same.
SKIPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar sidenav aside footer masthead comment comments reply replies disqus cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager search skip complementary contentinfo".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article main content post entry story".split())
_closes = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_scopes = frozenset("ul ol dl table select article section div main body nav aside".split())


DEEPEST = 512  # levels of nesting that paths tell apart, and that an end tag looks back
LEAST_PAGES = 3  # different pages of a host of which equal words say something
MOST_BROADCAST = 64 << 20  # characters of host names and paths that are sent to every executor; more are joined by a shuffle


@dataclass
class Page:
    """slots: (path, text, skipped, main). tokens: path -> times; chars: path -> characters of text in it that aren't skipped."""

    slots: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    tokens: Counter = field(default_factory=Counter)
    chars: Counter = field(default_factory=Counter)


def tokens(source: str) -> Iterator[re.Match]:
    """Tags, comments and text, in time linear in the page: from a tag whose quotes are never closed on, quotes are letters."""
    last = source.rfind(">") + 1
    at = 0
    for pattern in (_strict, _loose):
        for m in pattern.finditer(source, at, last):
            if pattern is _strict and m[0] == "<" and _opens.match(source, m.start(), last):
                at = m.start()
                break
            yield m
        else:
            at = last
            break
    yield from _rest.finditer(source, last)


def parse(source: str) -> Page:
    """Slots and tokens of one page, whatever state its markup is in."""
    page = Page()
    stack: list[tuple[str, str, bool, bool]] = []  # element, path, skipped, main
    text: list[str] = []
    where = ("", "", False, False)
    raw = ""

    def flush() -> None:
        nonlocal text
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text = []
            if words:
                page.slots.append((where[1], words, where[2], where[3]))
                if not where[2]:
                    path = where[1]
                    while path:
                        page.chars[path] += len(words)
                        path = path.rpartition("/")[0]

    def pop(to: int) -> None:
        flush()
        del stack[to:]

    for m in tokens(source):
        name = m[2] or None
        if raw:
            if not (name and m[1] and name.lower() == raw):
                continue
            raw = ""
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if not text:
                    where = stack[-1] if stack else ("", "", False, False)
                text.append(m[0])
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if m[1]:
            at = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1) if stack[i][0] == name), None)
            pop(at if at is not None else len(stack))
            continue
        flush()
        if name == "br":
            continue
        if name not in VOID:
            ends = _closes.get(name, set())
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                if stack[i][0] in ends or stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in _scopes:
                    break
        label, skipped, main, words = name, name in SKIPPED, name in MAIN_TAGS, []
        if m[3]:
            for k, a, b, c in _named.findall(m[3]):
                k, value = k.lower(), a or b or c
                if k in ("class", "id", "role"):
                    label += {"class": ".", "id": "#", "role": "@"}[k] + ".".join(sorted(value.replace("/", " ").split()))
                    words += _split.split(value)
                elif k == "hidden" or k == "aria-hidden" and value.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", value):
                    skipped = True
            words = {w.lower() for w in words}
            main = main or bool(words & MAIN_NAMES)
            skipped = skipped or name not in MAIN_TAGS and name != "body" and bool(words & SKIPPED_NAMES)
        above = stack[-1] if stack else ("", "", False, False)
        if name == "header" and not above[3] or "header" in words and not above[3] and not main:
            skipped = True
        path = above[1] if len(stack) >= DEEPEST else f"{above[1]}/{label}" if above[1] else label
        page.tokens[path] += 1
        if name not in VOID:
            if name in RAW:
                raw = name
            stack.append((name, path, above[2] or skipped, above[3] or main))
    flush()
    return page


def deduce(roles: list[dict], pages: int, words: list[dict] | None = None) -> dict:
    """Template of a host from its tokens: classes with their parents, paths whose slot is constant, and the article's path.

    roles: elements (path, vector, pages, chars in it, and own, letters: characters of its slot with and without spaces).
    words: words of text (path, vector, chars: letters of all its occurrences).
    """
    classes: dict[tuple, list[dict]] = {}
    for r in roles:
        if 2 * r["pages"] >= pages:
            classes.setdefault((r["vector"], r["pages"]), []).append(r)
    template = []
    for members in sorted(classes.values(), key=lambda x: (min(m["path"].count("/") for m in x), min(m["path"] for m in x))):
        paths = sorted(m["path"] for m in members)
        parent = max((i for i, t in enumerate(template) if any(paths[0].startswith(p + "/") for p in t["paths"])), key=lambda i: max(len(p) for p in template[i]["paths"] if paths[0].startswith(p + "/")), default=None)
        template.append({"paths": paths, "parent": parent})
    held: dict = {}
    for members in classes.values():
        held.setdefault(members[0]["vector"], set()).update(m["path"] for m in members)
    fixed: Counter = Counter()
    for w in words or ():
        if any(p in held.get(w["vector"], ()) for p in _above(w["path"])):
            fixed[w["path"]] += w["chars"]
    kept = {r["path"]: r for members in classes.values() for r in members}
    constant = {p for p, n in fixed.items() if p in kept and n >= kept[p]["letters"]}
    variable = Counter({p: r["chars"] for p, r in kept.items()})
    for c in constant:
        for p in _above(c):
            variable[p] -= kept[c]["own"]
    usable = {p: n for p, n in variable.items() if p in kept and n > 0}
    total = max(usable.values(), default=0)
    outer = set(template[0]["paths"]) if template else set()
    best = max((p for p, n in usable.items() if n >= 0.8 * total and p in outer), key=lambda p: (p.count("/"), usable[p]), default="")
    named = [p for p, n in usable.items() if _is_main(p.rpartition("/")[2]) and (not best or 2 * n >= usable[best] and best in _above(p))]
    if pages < LEAST_PAGES or not best or _is_text(best) or named:
        named = named or [p for p in usable if _is_main(p.rpartition("/")[2])]
        if named:  # the outermost of those that are named as the article, with the most text
            best = max(named, key=lambda p: (usable[p], -p.count("/")))
        elif pages < LEAST_PAGES or not best:  # the innermost that holds most of the text
            best = max((p for p, n in usable.items() if n >= 0.8 * total), key=lambda p: (p.count("/"), usable[p]), default="")
        if _is_text(best):
            best = best.rpartition("/")[0] or best
    return {"template": template, "article": best, "constant": sorted(constant)}


def _word_sets(page: Page) -> dict[str, int]:
    """For each path a hash of the set of its words; a slot is constant only where all pages that hold it have one set."""
    sets: dict[str, set[str]] = {}
    for path, text, skipped, _ in page.slots:
        if not skipped:
            sets.setdefault(path, set()).update(text.split(" "))
    return {p: int.from_bytes(hashlib.blake2b("\0".join(sorted(w)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for p, w in sets.items()}


def _above(path: str) -> Iterator[str]:
    """The path and those of the elements that hold it."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def _is_text(path: str) -> bool:
    return re.split(r"[.#@]", path.rpartition("/")[2])[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6")


def _is_main(label: str) -> bool:
    return re.split(r"[.#@]", label)[0] in MAIN_TAGS or bool({w.lower() for x in re.split(r"[.#@]", label)[1:] for w in _split.split(x)} & MAIN_NAMES)


def extract(spark: SparkSession, pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    References are decoded, white space within a block becomes one space, and blocks are joined in page order by one
    space. Null or empty html gives an empty text. Pages of a host of which the template does not fit, and hosts of fewer
    than LEAST_PAGES different pages, are judged by their own elements: the lists of names say what is an article and
    what isn't. The lists are also asked about variable slots (adverts or menus that change from page to page), and for
    an element named as the article within the one that the classes give. A slot with any variable word is extracted
    whole. A null url, or one without a host, belongs to the host "". Repeated rows are extracted alike and count as one
    page; an empty table gives no rows; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html")).withColumn("host", host)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    slot = pa.struct([("path", pa.string()), ("text", pa.string()), ("skipped", pa.bool_()), ("main", pa.bool_())])
    token = pa.struct([("path", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                parsed = [parse(x or "") for x in batch.column(2).to_pylist()]
                slots = pa.array([[dict(zip(("path", "text", "skipped", "main"), s, strict=True)) for s in p.slots] for p in parsed], pa.list_(slot))
                tokens = pa.array([[{"path": k, "n": n, "chars": p.chars.get(k, 0), "words": w.get(k, 0)} for k, n in p.tokens.items()] for p, w in zip(parsed, map(_word_sets, parsed), strict=True)], pa.list_(token))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), slots, tokens], names=["page_id", "url", "host", "slots", "tokens"])

    schema = f"page_id {kinds['page_id']}, url string, host string, slots array<struct<path string, text string, skipped boolean, main boolean>>, tokens array<struct<path string, n long, chars long, words long>>"
    parsed = scratch.written(spark, rows.mapInArrow(run, schema).withColumn("key", F.xxhash64("slots", "tokens")), "slots")
    number = parsed.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    part = [F.xxhash64("key", F.lit(i)).bitwiseAND((1 << 31) - 1) for i in range(2)]  # a vector is the sum of n times these

    def vector(times: Column) -> Column:
        return F.concat_ws(" ", *[F.sum(times * p) for p in part]).alias("vector")

    each = parsed.select("host", "key", F.explode("tokens").alias("t")).groupBy("host", "key", "t.path").agg(F.count("*").alias("copies"), F.max("t.n").alias("n"), F.max("t.chars").alias("chars"), F.max("t.words").alias("words"))
    roles = each.groupBy("host", "path").agg(vector(F.col("copies") * F.col("n")), F.count("*").alias("pages"), F.sum(F.col("copies") * F.col("chars")).alias("chars"), ((F.min("words") == F.max("words")) & (F.max("words") != 0)).alias("alike"))
    common = roles.join(number, "host").where("2 * pages >= host_pages")  # not more roles than two pages hold, on average
    common = scratch.written(spark, common, "roles")
    alike = common.where(F.col("alike") & (F.col("host_pages") >= LEAST_PAGES)).select("host", "path")
    size = alike.agg(F.sum(F.length("host") + F.length("path") + 32)).head()[0] or 0
    shown = parsed.select("host", "key", F.explode(F.filter("slots", lambda s: ~s["skipped"])).alias("s")).select("host", "key", "s.path", "s.text")
    shown = shown.join(F.broadcast(alike) if size <= MOST_BROADCAST else alike, ["host", "path"], "left_semi")
    letters = shown.groupBy("host", "path").agg(F.sum(F.char_length("text")).alias("own"), F.sum(F.char_length(F.replace("text", F.lit(" "), F.lit("")))).alias("letters"))
    common = common.join(letters, ["host", "path"], "left").na.fill(0, ["own", "letters"])
    hosts = common.groupBy("host").agg(F.first("host_pages").alias("host_pages"), F.collect_list(F.struct("path", "vector", "pages", "chars", "own", "letters")).alias("roles"))
    each = shown.select("host", "key", "path", F.explode(F.split("text", " ")).alias("word")).select("host", "key", "path", F.xxhash64("word").alias("word"), F.char_length("word").alias("size"))
    words = each.groupBy("host", "path", "word").agg(vector(F.lit(1)), F.sum("size").alias("chars"))
    words = words.join(common.select("host", "vector").distinct(), ["host", "vector"], "left_semi")
    words = words.groupBy("host").agg(F.collect_list(F.struct("path", "vector", "chars")).alias("words"))
    hosts = hosts.join(words, "host", "left")

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduce(r, n, w) for n, r, w in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f["article"] for f in found], pa.string()), pa.array([f["constant"] for f in found], pa.list_(pa.string()))], names=["host", "article", "constant"])

    article = scratch.written(spark, hosts.mapInArrow(templates, "host string, article string, constant array<string>"), "templates")
    size = article.agg(F.sum(F.length("host") + F.length("article") + F.length(F.array_join("constant", " ")) + 32)).head()[0] or 0
    article = F.broadcast(article) if size <= MOST_BROADCAST else article
    both = parsed.select("page_id", "url", "host", "slots").join(article, "host", "left")
    own = F.filter("slots", lambda s: ~s["skipped"] & ~F.coalesce(F.array_contains("constant", s["path"]), F.lit(False)))
    both = both.withColumn("slots", F.when(F.size(own) > 0, own).otherwise(F.filter("slots", lambda s: ~s["skipped"])))
    inside = F.filter("slots", lambda s: (s["path"] == F.col("article")) | s["path"].startswith(F.concat("article", F.lit("/"))))
    named = F.filter("slots", lambda s: s["main"])
    chosen = both.withColumn("inside", inside).withColumn("named", named)
    picked = F.when((F.col("article") != "") & (F.size("inside") > 0), F.col("inside")).when(F.size("named") > 0, F.col("named")).otherwise(F.col("slots"))
    text = F.array_join(F.transform(picked, lambda s: s["text"]), " ")
    return chosen.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


OP8_SQL = r"""
WITH body AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
plain AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM body)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM plain
"""
