"""Main text of HTML pages by differencing each page with the pages of the nearest URLs.

Pages are laid out by host and URL path (in ranges, so a host with a third of all pages is spread
over many tasks) and each is paired with its neighbour on either side, of those whose lines aren't the
same.  A range gets the neighbours of its first and last pages from other ranges.  The text lines of
two pages are aligned by their longest common subsequence.

Differencing comes first, over all lines of the page, menus and headers included: a line that the
page has in common with both of its neighbours is the site's and goes; where one of them shares fewer
leading folders of the path, the nearer one alone decides.  What it can't tell is put right by the line's place in the page: lines inside a marked article
are restored (articles of a host quote and repeat one another), and lines that no neighbour has are
vetoed in navigation, headers, footers, sidebars, forms, adverts, notices and comments (menus and
adverts differ from page to page).  The result counts the lines of each kind.
"""

from __future__ import annotations

import bisect
import hashlib
import html as _html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names and common whole class words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "select", "svg", "title", "head", "object", "math", "canvas", "xmp")
_DROP = frozenset("nav header footer aside form dialog menu button".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies respond share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget widgets "
    "ad-banner ad-container ad-slot ad-unit ad-wrapper breadcrumb-nav comment-form comment-list comments-area cookie-banner cookie-bar cookie-consent "
    "cookie-notice main-menu main-nav nav-bar nav-menu newsletter-signup page-footer page-header popup-overlay post-navigation promo-box related-articles "
    "related-posts share-bar share-buttons side-bar sidebar-left sidebar-right site-footer site-header site-nav social-links social-share top-nav".split()
)
#: Whole class words of a container of reader comments, by rule: whose they are, comments, what holds them.
_COMMENTS = re.compile(r"(?:(?:user|reader|post|page|article|blog|site|wp|fb)-)?comments?(?:-(?:section|list|area|thread|box|wrap|wrapper|container|form|body|item|block|feed|stream))?|(?:respond|replies|disqus)(?:-thread)?")
_KEPT = frozenset("html body main article".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_P_ENDS = _BLOCK - {"body", "html"}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Bits that aligning two pages may hold at once.
MOST_BITS = 1 << 28
_SPACE = re.compile(r"\s+")
_KEY = ("host", "path", "id", "tie")
_DIGEST = "part int, host string, path string, id long, tie long, digest binary"
_TEXT = "page_id long, url string, text string, n_chars long, n_shared long, n_restored long, n_vetoed long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by name; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _unwanted(name: str, attributes: dict[str, str]) -> bool:
    role = attributes.get("role", "").strip()
    if role in _BAD_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if name in _KEPT or role == "main":  # a class word says something about the page's layout here
        return False
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".replace("_", "-").split()
    return not _BAD_WORDS.isdisjoint(words) or any(map(_COMMENTS.fullmatch, words))


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the > that ends a tag begun before `at`, -1 if none: not one inside a quoted value.  A
    quote that never closes (its last place is `last`) quotes nothing.  Every character is seen once."""
    while True:
        stop = _TAG_STOP.search(page, at)
        if stop is None:
            return -1
        if stop[0] == ">":
            return stop.start()
        quote, at = stop[1], stop.end()
        if at <= last[quote]:
            at = page.index(quote, at) + 1


def page_lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order: (line, place), place 1 inside an article, -1 inside an
    unwanted element, 0 elsewhere.

    Reads the page once, in time proportional to its length.  A comment, declaration or raw element
    that isn't closed goes on to the page's end, and so does a tag; a < that begins none is text.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, unwanted elements up to it, articles up to it
    drop = article = at = 0
    n = len(page)
    last = {q: page.rfind(q) for q in "\"'"}

    def flush():
        if text:
            line = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, -1 if drop else int(article > 0)))

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text.append(page[at:])
            break
        if begin > at:
            text.append(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        found = _NAME.match(page, begin)
        if found is None:
            text.append("<")
            at = begin + 1
            continue
        name, closing = found[1].lower(), page[begin + 1] == "/"
        end = _tag_end(page, found.end(), last)
        if end < 0:
            break
        source, at = page[found.end() : end], end + 1
        if name in _ENDS and not closing:
            if name == "head":
                continue
            end = _ENDS[name].search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1:] != (drop, article):
                        flush()
                    _, drop, article = stack[k]
                    del stack[k:]
                    break
            continue
        if name in _P_ENDS and stack and stack[-1][0] == "p":  # a block ends an open paragraph
            _, drop, article = stack.pop()
        if name in _VOID or source.endswith("/") and name not in _BLOCK:
            continue
        stack.append((name, drop, article))
        attributes = _attributes(source) if source else {}
        # A header inside an article holds its title.
        unwanted = name in _DROP and not (name == "header" and article) or attributes and _unwanted(name, attributes)
        if unwanted and not drop:
            flush()
        if name in ("article", "main") or attributes.get("role", "").strip() == "main":
            article += 1
        if unwanted:
            drop += 1
    flush()
    return out


def _marks(left: list[str], right: list[str]):
    """Bit vectors of a longest common subsequence, one after each line of left: the lines of right are
    bits, and a cleared bit is a line where the subsequence with left so far gets longer."""
    where: dict[str, int] = {}
    for j, line in enumerate(right):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(right)) - 1
    v = full
    for line in left:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of left and right[:j], for j from 0."""
    v = (1 << len(right)) - 1
    for v in _marks(left, right):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(right) // 8), "little"), dtype=np.uint8), bitorder="little")[: len(right)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _matched(left: list[str], right: list[str]) -> list[int]:
    """Places in left of a longest common subsequence with right."""
    rows, found = list(_marks(left, right)), []
    i, j = len(left), len(right)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i == 0 or rows[i - 1] >> (j - 1) & 1:  # the step came with this line: a match
                found.append(i)
                j -= 1
    return found


def common_lines(a: list[str], b: list[str], most_bits: int = MOST_BITS) -> set[int]:
    """Places in a of a longest common subsequence of a and b (bit-parallel, a bit for each line of b).

    Where the bits of all lines would be more than `most_bits`, a is halved and b cut where the halves'
    subsequences are longest together, again and again; so memory is bounded by the longer of both
    and `most_bits`."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = {*range(begin), *range(len(a) - end, len(a))}
    left, right = a[begin : len(a) - end], b[begin : len(b) - end]
    both = {*left} & {*right}  # other lines match nothing
    if not both:
        return shared
    places, left = zip(*((k, x) for k, x in enumerate(left) if x in both), strict=True)
    right = [x for x in right if x in both]
    parts = [(0, len(left), 0, len(right))]
    while parts:
        i, i_end, j, j_end = parts.pop()
        mine, other = list(left[i:i_end]), right[j:j_end]
        if len(mine) * len(other) <= most_bits or len(mine) < 2:
            shared.update(begin + places[i + k] for k in _matched(mine, other))
            continue
        half = len(mine) // 2
        ahead, back = _lengths(mine[:half], other), _lengths(mine[half:][::-1], other[::-1])
        cut = int(np.argmax(ahead + back[::-1]))
        parts += [(i, i + half, j, j + cut), (i + half, i_end, j + cut, j_end)]
    return shared


def _folders(a: str, b: str) -> int:
    """Leading folders that two paths share."""
    n = 0
    for x, y in zip(a.split("/")[:-1], b.split("/")[:-1]):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _main_text(lines: list[tuple[str, int]], near: list[list[tuple[str, int]]]) -> tuple[str, int, int, int]:
    """Text, and the lines that differencing dropped, that an article restored, that a place vetoed."""
    own = [x for x, _ in lines]
    common = [common_lines(own, [x for x, _ in other]) for other in near]
    shared = set.intersection(*common) if common else set()
    kept = [line for k, (line, place) in enumerate(lines) if place > 0 or place == 0 and k not in shared]
    restored = sum(place > 0 for k, (_, place) in enumerate(lines) if k in shared)
    vetoed = sum(place < 0 for k, (_, place) in enumerate(lines) if k not in shared)
    return "\n".join(kept), len(shared) - restored, restored, vetoed


def _ranges(keys: DataFrame, n: int) -> list[tuple]:
    """At most n - 1 keys that cut the rows into ranges of about equal numbers, from a sample."""
    rows = keys.count()
    if n < 2 or not rows:
        return []
    sample = sorted(tuple(r) for r in keys.sample(min(1.0, 40 * n / rows), seed=0).collect())
    return sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []


def _edges(rows: DataFrame, bounds: list[tuple]) -> list[tuple]:
    """(range, place, key, digest of the lines) of the first pages of the first two runs of each range
    (places 0 and 1) and the last pages of its last two runs (places 2 and 3, the last one 3).  A run
    is pages of a host in order whose lines are equal; pages without lines don't count."""

    def digests(batches):
        for batch in batches:
            found = []
            for *key, source in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "html")), strict=True):
                lines = page_lines(source or "")
                if lines:
                    found.append((bisect.bisect_right(bounds, tuple(key)), *key, hashlib.blake2b("\n".join(x for x, _ in lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()))
            yield _batch(found, _DIGEST)

    def ends(batches):
        out: list[tuple] = []
        part = run = last = None
        begun = 0
        seen: list[tuple] = []  # last page of the run before

        def close():
            if last:
                out.extend((2, *x) for x in seen)
                out.append((3, *last))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part:
                    close()
                    part, run, last, begun = row[0], None, None, 0
                    seen.clear()
                if (row[1], row[-1]) != run:
                    if begun < 2:
                        out.append((begun, *row))
                    begun += 1
                    if last:
                        seen[:] = [last]
                    run = row[1], row[-1]
                last = row
        close()
        if out:
            yield _batch(out, f"place int, {_DIGEST}")

    small = rows.select(*_KEY, "html").mapInArrow(digests, _DIGEST)
    laid = small.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", *_KEY)
    return [(r["part"], r["place"], tuple(r[c] for c in _KEY), bytes(r["digest"])) for r in laid.mapInArrow(ends, f"place int, {_DIGEST}").collect()]


def _carried(edges: list[tuple], n: int) -> dict[tuple, list[int]]:
    """Pages that ranges need from the ranges beside them: key -> ranges.  A range needs the nearest
    page of the host before its first run whose lines differ from the run's, and likewise after its
    last run, however many ranges away."""
    by: list[dict[int, tuple]] = [{} for _ in range(n)]
    for part, place, key, digest in edges:
        by[part][place] = key, digest
    wanted: dict[tuple, list[int]] = {}
    for part in range(n):
        for own, others, places in ((0, range(part - 1, -1, -1), (3, 2)), (3, range(part + 1, n), (0, 1))):
            if own not in by[part]:
                continue
            key, digest = by[part][own]
            near = (by[q][k] for q in others for k in places if k in by[q])
            for other, its in near:
                if other[0] != key[0]:
                    break
                if its != digest:
                    wanted.setdefault(other, []).append(part)
                    break
    return wanted


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=_ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_restored, n_vetoed: a row for each row of pages.

    Character references are decoded, white space inside a block is one space, blocks are trimmed
    and joined by one newline.  n_shared lines went as the site's, n_restored were common too but stand
    in a marked article, n_vetoed went for their place.  A null or empty page has the empty text; a
    null url pairs with nothing but other null urls.  A page is compared with the nearest page before
    it and the nearest after it, of its host, in order of path, page_id and text, whose lines differ from its
    own (and that have any), or with one of them, if that shares more leading folders of the path.  So copies of a page keep its text; of equal paths the smaller page_id comes
    first.  The pairs don't depend on the ranges, as each gets the pages that it needs from others.
    Finding those reads and parses all pages once, when extract() is called.  Other columns are
    ignored.  An empty table gives an empty result.  `ranges`: tasks at most; by default the session's
    shuffle partitions, of 200 pages or more.
    """
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    rows = pages.select(
        "page_id", "url", F.lower(F.substring_index(bare, "/", 1)).alias("host"), F.regexp_replace(bare, r"^[^/]*/?", "").alias("path"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("html").alias("tie"), "html",
    )
    if ranges is None:
        ranges = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.count() // 200)
    bounds = _ranges(rows.select("host", "path", "id"), ranges)
    n = len(bounds) + 1
    carried = _carried(_edges(rows, bounds), n) if bounds else {}

    @F.pandas_udf("array<int>")
    def parts(host: pd.Series, path: pd.Series, id_: pd.Series, tie: pd.Series) -> pd.Series:
        keys = zip(host, path, map(int, id_), map(int, tie), strict=True)
        return pd.Series([[bisect.bisect_right(bounds, key), *carried.get(key, ())] for key in keys], dtype=object)

    laid = rows.select("*", F.posexplode(parts(*_KEY) if bounds else F.array(F.lit(0))).alias("guest", "part"))
    laid = laid.repartitionById(n, F.col("part")).sortWithinPartitions("part", *_KEY)

    def run(batches):
        before = None  # (path, lines) of the last page of the run before
        place = None  # range and host
        held: list[tuple] = []  # pages of the run: (page_id, url, path, lines), lines None where they are the run's
        now: list[tuple[str, int]] = []  # lines of the run
        last = ""  # path of its last page
        done: list[tuple] = []

        def settle(after):
            beside = [x for x in (before, after) if x]
            of_run: dict[tuple, tuple] = {}  # by the neighbours that decide
            for page_id, url, path, lines in held:
                shared = [_folders(path, x[0]) for x in beside]
                nearest = tuple(k for k, n in enumerate(shared) if n == max(shared))
                near = [beside[k][1] for k in nearest]
                if lines is not None:
                    result = _main_text(lines, near)
                else:
                    if nearest not in of_run:
                        of_run[nearest] = _main_text(now, near)
                    result = of_run[nearest]
                done.append((page_id, url, result[0], len(result[0]), *result[1:]))
                if len(done) >= 500:
                    yield _batch(done, _TEXT)
                    done.clear()
            held.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "host", "path", "html", "guest", "part")]
            for r in range(batch.num_rows):
                page_id, url, host, path, source, guest, part = (c[r].as_py() for c in columns)
                lines = page_lines(source or "")
                if not lines:
                    if not guest:
                        done.append((page_id, url, "", 0, 0, 0, 0))
                    continue
                alike = lines == now
                if (part, host) != place:
                    yield from settle(None)
                    place, before, now = (part, host), None, lines
                elif not alike and [x for x, _ in lines] != [x for x, _ in now]:
                    yield from settle((path, lines))
                    before, now = (last, now), lines
                last = path
                if not guest:
                    held.append((page_id, url, path, None if alike or lines is now else lines))
        yield from settle(None)
        if done:
            yield _batch(done, _TEXT)

    return laid.mapInArrow(run, _TEXT)
