"""HTML extraction by consensus host paths.

Each page's text is followed from the root down for as long as one container holds nearly all of it; a
container is known by its path of tags and classes, generalised (digits dropped, classes sorted), from
the root, whose own path is empty. Every page votes for the path it ends at, Spark sums the votes of
each host, and each page is extracted again from the containers on the host's winning paths. A page
that has none of them falls back to its own best container.

A page is read once from start to end, in time that follows its length however deep or broken its
markup is. Paths are nodes of a tree, known by number within a page and by a 64-bit hash across pages.

Elements that tags or class words mark as menus, adverts, comments and the like are only suspects. One
that holds most of a page's running text, with its heading or where no heading or article stands
elsewhere, is a wrapper and stays. Others of plain words are weighed by length and links inside an article, and
outside by the host's pages too: there they stay only if what stands on their path varies from page to page.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import boxed, inside, materialize, scratch_dir, small_side
from .tokens import texts

#: Elements whose content is no text of the page, and those whose content is not the article's.
RAW = frozenset("script style noscript template svg iframe object textarea title select option".split())
BARE = frozenset("script style textarea title".split())
BARE_END = {tag: re.compile(rf"</{tag}\b[^>]*+>?", re.I) for tag in BARE}
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Words of a class or id that make an element a suspect. What adverts, notices and readers say may be long; the
#: doubtful and the soft count against an element only if it is short or mostly links, and outside an article the soft
#: also if the host's pages don't speak for it.
REMARKS, ADVERTS, DOUBTFUL, SOFT = (
    re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
    for words in (
        r"comments?|replies|respond",
        r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|popup|modal|newsletter|subscribe",
        r"side|header|notice|social|related|recommend\w*|toc",
        r"banner|menu|nav\w*|breadcrumbs?|sidebar|footer|masthead|discussion|share|sharing|widget|pagination|pager|skip|login|signup",
    )
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article main section div body td".split())
#: An open element of the value's tags is closed by the start of the key's.
CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
#: Elements beyond which an end tag or an implied end doesn't reach.
BOUNDS = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
#: Quotes count only after an equals sign, and only if they are closed; so no match goes back on itself.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
ASKED = re.compile("class|id|role|hidden", re.I)
SPACES = re.compile(r"[\s​]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A container is left for one inside it that holds this share of its text, unless it has a heading or
#: a block of so many characters of its own.
NEARLY_ALL, RUNNING = 0.9, 100
#: Winning paths of a host hold at least this share of the votes of its most voted path, and of all its votes.
NEAR_WINNER, LEAST_SHARE = 0.5, 0.02
#: A doubtful element stays if it has so many characters, and no larger share of them in links.
LONG, LINKED = 200, 0.33
#: A suspect with at least this share of a page's running text may be a wrapper.
MOST_TEXT = 0.5


class Suspect:
    """An element that may not belong to the main text, and what it holds: characters, those in links, headings and
    articles. ``kind`` is "remarks", "noise", "form", "doubtful" or "soft"; ``path`` a hash of where it stands.
    """

    __slots__ = ("above", "articles", "chars", "heads", "inside", "kind", "linked", "path", "said")

    def __init__(self, kind: str, above: int, inside: bool, path: int):
        self.kind, self.above, self.inside, self.path = kind, above, inside, path
        self.chars = self.linked = self.heads = self.articles = 0
        self.said: list[str] = []


def _hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """The runs of text between a page's block boundaries, in page order, and the tree of its containers.

    Malformed markup never fails: an end tag closes the nearest open element of its name within bounds, a start
    tag closes what it can't stand in, and the end closes all. ``varied`` are the paths of soft suspects that the
    host's pages speak for.
    """

    def __init__(self, html: str, varied: frozenset[int] = frozenset()):
        #: (container, text, characters in links, dropped, heading) of each run.
        self.runs: list[tuple[int, str, int, bool, bool]] = []
        #: Of each container, the root first: its parent, whether it is an article, and the hash of its path.
        self.parents, self.articles, self.hashes = [-1], [False], [0]
        self._known: dict[tuple[int, str], int] = {}
        self.suspects: list[Suspect] = []
        self._read(html, varied)

    def _container(self, parent: int, tag: str, names: str) -> int:
        name = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in names.lower().split()} - {""})])
        if (parent, name) not in self._known:
            self._known[parent, name] = len(self.parents)
            self.parents.append(parent)
            self.articles.append(tag == "article")
            self.hashes.append(_hashed(f"{self.hashes[parent]}/{name}"))
        return self._known[parent, name]

    def _kind(self, tag: str, said: str, in_article: bool) -> str | None:
        """Why an element is a suspect, if it is."""
        if tag in ("html", "body", "article", "main"):
            return "remarks" if tag == "article" and REMARKS.search(said) else None
        if REMARKS.search(said):
            return "remarks"
        if tag in ASIDE or ADVERTS.search(said) or tag == "header" and not in_article:
            return "form" if tag == "form" else "noise"
        if SOFT.search(said):
            return "soft"
        return "doubtful" if DOUBTFUL.search(said) and not (in_article and "header" in said.lower()) else None

    def _read(self, html: str, varied: frozenset[int]) -> None:
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]  # tag, container, hidden, suspect
        open_at: dict[str, list[int]] = {}  # places in the stack, by tag
        bounds = [0]
        n_links = n_headings = n_articles = links = 0
        free_heads = free_articles = 0  # outside all suspects
        buffer: list[str] = []
        found: list[tuple[int, str, int, bool, bool, int]] = []
        at, size, suspects = 0, len(html), self.suspects

        def flush():
            nonlocal links
            if buffer:
                text = SPACES.sub(" ", "".join(buffer)).strip()
                if text:
                    _, container, hidden, suspect = stack[-1]
                    found.append((container, text, min(links, len(text)), hidden, n_headings > 0, suspect))
                buffer.clear()
            links = 0

        def put(raw: str):
            nonlocal links
            if raw:
                text = unescape(raw) if "&" in raw else raw
                buffer.append(text)
                if n_links:
                    links += len(text.strip())

        def close_to(k: int):
            nonlocal n_links, n_headings, n_articles
            if any(stack[i][0] in BLOCK for i in range(k, len(stack))):
                flush()
            while len(stack) > k:
                tag = stack.pop()[0]
                open_at[tag].pop()
                n_links -= tag == "a"
                n_headings -= tag in HEADINGS
                n_articles -= tag in ("article", "main")
                if bounds[-1] == len(stack):
                    bounds.pop()

        def last(tag: str) -> int:
            places = open_at.get(tag)
            return places[-1] if places else 0

        while at < size:
            m = TAG.search(html, at)
            if not m:
                put(html[at:])
                break
            put(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                k = last(tag)
                if k and (tag in BOUNDS or k > bounds[-1]):
                    close_to(k)
                elif not k and tag in BLOCK:
                    flush()
                continue
            if tag in BARE:  # its content has no tags
                end = BARE_END[tag].search(html, at)
                at = end.end() if end else size
                continue
            if tag == "br":
                buffer.append(" ")
            while tag in CLOSES and (k := max(map(last, CLOSES[tag]))) and k >= bounds[-1]:
                close_to(k)
            if tag in BLOCK:
                flush()
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(m[3])} if ASKED.search(m[3]) else {}
            names = attrs.get("class", "")
            _, container, hidden, suspect = stack[-1]
            if tag in CONTAINER:
                container = self._container(container, tag, names)
            hidden = hidden or tag in RAW or tag == "button" or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            said = f"{names} {attrs.get('id', '')} {attrs.get('role', '')}"
            kind = self._kind(tag, said, n_articles > 0)
            if kind:
                name = re.sub(r"\d+", "", said.lower())
                suspects.append(Suspect(kind, suspect, n_articles > 0, _hashed(f"{self.hashes[container]}/{tag} {name}")))
                suspect = len(suspects) - 1
            if tag in ("h1", "main", "article"):
                of = suspects[suspect] if suspect >= 0 else None
                if tag == "article":
                    free_articles += not of
                    if of and kind is None:
                        of.articles += 1
                else:
                    free_heads += not of
                    if of:
                        of.heads += 1
            open_at.setdefault(tag, []).append(len(stack))
            if tag in BOUNDS:
                bounds.append(len(stack))
            n_links += tag == "a"
            n_headings += tag in HEADINGS
            n_articles += tag in ("article", "main")
            stack.append((tag, container, hidden, suspect))
        flush()
        noise = self._noise([run for run in found if not run[3]], free_heads, free_articles, varied) if suspects else []
        self.runs = [(*run[:3], run[3] or run[5] >= 0 and noise[run[5]], run[4]) for run in found]

    def _noise(self, shown: list, free_heads: int, free_articles: int, varied: frozenset[int]) -> list[bool]:
        """Of each suspect whether it, or one around it, is noise."""
        suspects, running = self.suspects, 0
        for _, text, n, _, _, k in shown:
            running += len(text) - n
            if k >= 0:
                suspects[k].chars += len(text)
                suspects[k].linked += n
                if suspects[k].kind == "soft":
                    suspects[k].said.append(text)
        # Headings and articles that stand outside a suspect: those of what is around it.
        outside = []
        for s in suspects:
            heads, articles = (free_heads, free_articles) if s.above < 0 else outside[s.above]
            if s.above >= 0:
                heads, articles = heads + suspects[s.above].heads, articles + suspects[s.above].articles
            outside.append((heads, articles))
        for s in reversed(suspects):  # what is around a suspect comes before it
            if s.above >= 0:
                above = suspects[s.above]
                above.chars, above.linked, above.heads, above.articles = above.chars + s.chars, above.linked + s.linked, above.heads + s.heads, above.articles + s.articles
        noise = []
        for s, (heads, articles) in zip(suspects, outside, strict=True):
            # A form may be round a page; what is said in a footer, an advert or a remark is no main text for want of another.
            alone = not heads and not articles and (s.kind in ("form", "doubtful", "soft") or s.articles > 0)
            if s.chars - s.linked >= MOST_TEXT * running and s.chars > s.linked and (s.heads > 0 or alone):
                bad = False  # a wrapper
            elif s.kind in ("remarks", "noise", "form"):
                bad = True
            else:
                bad = s.chars < LONG or s.linked > LINKED * s.chars or s.kind == "soft" and not s.inside and s.path not in varied
            noise.append(bad or s.above >= 0 and noise[s.above])
        return noise

    def asked(self) -> list[tuple[int, int]]:
        """(path, hash of the text) of the long soft suspects outside articles, for the host to decide on."""
        return [(s.path, _hashed("\n".join(s.said))) for s in self.suspects if s.kind == "soft" and not s.inside and s.chars >= LONG and s.linked <= LINKED * s.chars]

    def best(self) -> int | None:
        """The container that the page votes for: the innermost that holds nearly all text that isn't dropped or in links.

        An article is never left for a part of it. Of two containers with as much text the one of lower hash is taken.
        """
        total, stays, inside = [0] * len(self.parents), [False] * len(self.parents), [[] for _ in self.parents]
        for container, text, links, dropped, heading in self.runs:
            if not dropped and len(text) > 2 * links:
                total[container] += len(text) - 2 * links
                stays[container] |= heading or len(text) - 2 * links >= RUNNING
        for k in range(len(self.parents) - 1, 0, -1):  # parents come before children
            total[self.parents[k]] += total[k]
            inside[self.parents[k]].append(k)
        if not total[0]:
            return None
        at = 0
        while not self.articles[at] and not stays[at]:
            most = max(inside[at], key=lambda k: (total[k], -self.hashes[k]), default=None)
            if most is None or total[most] < NEARLY_ALL * total[at]:
                break
            at = most
        return at

    def text(self, winners: list[int]) -> str:
        """The text of the containers whose paths win, else of the page's own best one."""
        own, won = self.best(), set(winners)
        for chosen in ({k for k, h in enumerate(self.hashes) if h in won}, set() if own is None else {own}):
            inside = [k in chosen for k in range(len(self.parents))]
            for k in range(1, len(inside)):
                inside[k] |= inside[self.parents[k]]
            kept = [text for container, text, _, dropped, _ in self.runs if not dropped and inside[container]]
            if kept:
                return "\n\n".join(kept)
        return ""


def host(url):
    """The host of a URL column in lower case, null if there is none."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, said, n) of (host, html): how many pages of a host vote for a path, by its hash (said is null), or
    have a soft suspect of this path that says this, by its hash.

    Null and empty pages and such without text don't vote; a null host is a host; repeated rows vote as often; an
    empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hosts, paths, said = [], [], []
            for x, of in zip(texts(batch, "html"), batch.column("host").to_pylist(), strict=True):
                page = Page(x.decode("utf-8", "replace")) if x else None
                own = page.best() if page else None
                for path, text in ([] if own is None else [(page.hashes[own], None)]) + (page.asked() if page else []):
                    hosts.append(of)
                    paths.append(path)
                    said.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(said, pa.int64())], ["host", "path", "said"])

    return pages.select("host", "html").mapInArrow(run, "host string, path long, said long").groupBy("host", "path", "said").agg(F.count("*").alias("n"))


def winners(voted: DataFrame, near: float = NEAR_WINNER, least: float = LEAST_SHARE) -> DataFrame:
    """(host, paths, varied) of ``votes``: a host's most voted path, and those with at least ``near`` of its votes and
    ``least`` of all; and the paths of soft suspects on at least two pages, and ``least`` of all, most of which say
    something of their own. A host has 1 / ``least`` winners at most; no votes give no rows.
    """
    cast = voted.where("said is null")
    top = cast.groupBy(F.col("host").alias("of")).agg(F.max(F.struct("n", "path")).alias("top"), F.sum("n").alias("all"))
    same = F.col("host").eqNullSafe(F.col("of"))
    kept = cast.join(top, same).where((F.col("path") == F.col("top.path")) | ((F.col("n") > 1) & (F.col("n") >= F.col("top.n") * near) & (F.col("n") >= F.col("all") * least)))
    won = kept.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    suspects = voted.where("said is not null").groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n > 1 and 2 * texts > n")
    varied = suspects.join(top, same).where(F.col("n") >= F.col("all") * least).groupBy(F.col("host").alias("on")).agg(F.sort_array(F.collect_set("path")).alias("varied"))
    return won.join(varied, F.col("host").eqNullSafe(F.col("on")), "left").select("host", "paths", "varied")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page's main text.

    White space inside a block becomes one space, blocks are joined by two line ends. A null or empty
    page has empty text; a null or hostless url votes and is extracted with the others of its kind;
    repeated rows come out as often; an empty table gives no rows; a caller's columns may have any name.
    """
    rows = boxed(pages).select(inside(key).alias("key"), inside(url).alias("url"), inside(html).alias("html")).withColumn("host", host(F.col("url")))
    folder = scratch_dir(pages.sparkSession)
    voted = materialize(votes(rows), f"{folder}/votes")
    won = small_side(materialize(winners(voted).withColumnRenamed("host", "of"), f"{folder}/won"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bodies, paths, varied = texts(batch, "html"), batch.column("paths").to_pylist(), batch.column("varied").to_pylist()
            out = [Page(x.decode("utf-8", "replace"), frozenset(v or ())).text(p or []) if x else "" for x, p, v in zip(bodies, paths, varied, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["key", "url", "text", "n_chars"])

    joined = rows.join(won, F.col("host").eqNullSafe(F.col("of")), "left").select("key", "url", "html", "paths", "varied")
    types = joined.schema
    out = joined.mapInArrow(run, f"key {types['key'].dataType.simpleString()}, url {types['url'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
