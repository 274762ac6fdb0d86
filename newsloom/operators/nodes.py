"""Pages as node rows, and subtree work as windows over them.

A page becomes one row per node.  An element has an `open` row whose `end_ord`
is the position of its `close` row, so a subtree is the interval
[ord, end_ord]: the table stays linear in the page, however deep it nests, and
removing subtrees is a running maximum instead of a tree walk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom import settings

# Elements without content, and elements that start a text block.
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
))
BLOCK_TAGS = frozenset((
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "td", "th", "tr", "ul",
))
RAW_TEXT_TAGS = frozenset(("script", "style", "template"))
CANDIDATE_TAGS = frozenset(("article", "main"))
#: Tags that rules look at.  An element of any other tag, without role, class and href, is in no rule's reach.
_JUDGED = frozenset((*settings.REMOVED_TAGS, *settings.LINKY_TAGS, "a", "img", "head", *CANDIDATE_TAGS))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# a stretch of short leaves: whole block elements that no rule judges, with nothing but a text too short to count as a block,
# whose ampersands begin no reference.  It is its own markup but for those, and the tokeniser is in the same state after it.
_SHORT = settings.BLOCK_MIN_CHARS - 1
_LEAVES = re.compile(
    rf"(?:<({'|'.join(sorted(BLOCK_TAGS - _JUDGED - _HEADINGS))})>"
    rf"(?:[^<>&]{{0,{_SHORT}}}|(?:[^<>&]|&(?![#A-Za-z])){{0,{_SHORT}}})</\1>){{1,4096}}+")
_TAG = re.compile("<[^>]*>")

NODE = T.StructType([
    T.StructField("ord", T.IntegerType()),       # position in the page
    T.StructField("end_ord", T.IntegerType()),   # last position of the subtree
    T.StructField("elem", T.IntegerType()),      # ord of the element opened or closed, else ord
    T.StructField("kind", T.StringType()),       # open | close | void | text | raw | comment | error; packed: run | leaves
    T.StructField("tag", T.StringType()),        # of text: the tag of its block
    T.StructField("role", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("before", T.StringType()),     # markup before the href value
    T.StructField("after", T.StringType()),      # markup after it
    T.StructField("text", T.StringType()),
    T.StructField("block", T.IntegerType()),     # ord of the enclosing block element
    T.StructField("in_link", T.BooleanType()),
    T.StructField("within", T.ArrayType(T.IntegerType())),  # enclosing article and main elements
    T.StructField("parent", T.IntegerType()),    # of an element: ord of the element around it, -1 without one
    T.StructField("grand", T.IntegerType()),     # ord of the element around that
])
_AT = {f.name: i for i, f in enumerate(NODE.fields)}
_ARROW_TYPES = {"integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array": pa.list_(pa.int32())}


class _PageReader(HTMLParser):
    """Turns pages into node rows; rules are applied later, in Spark.

    Each open element carries what its descendants inherit: block, link, raw
    text and enclosing candidates.  A row has one more value than fields:
    whether a rule may judge its element.

    With `leaves`, a stretch of short leaves is read at once and is one row of
    kind leaves, whose `before` is the stretch as it was read.
    """

    def __init__(self, leaves=False):
        super().__init__(convert_charrefs=True)
        self.leaves, self.size = leaves, 0
        self.rows, self.stack, self.text, self.open = [], [], [], Counter()
        self.top = ("", "", 0, False, False, ())  # tag, block tag, block, in link, raw, within

    def _add(self, kind, tag=None, elem=None, role=None, cls=None, href=None, before=None, after=None, text=None, judged=False):
        at = self.size
        self.size += 1
        _, block_tag, block, in_link, _, within = self.top
        parent = grand = None
        if kind in ("open", "void"):
            around = self.stack[-2:]
            grand, parent = ([-1, -1] + [row[0] for row, _ in around])[-2:]
        self.rows.append([
            at, at, at if elem is None else elem, kind, block_tag if kind == "text" else tag,
            role, cls, href, before, after, text, block, in_link, within, parent, grand, judged,
        ])
        return at

    def parse_starttag(self, i):
        found = _LEAVES.match(self.rawdata, i) if self.leaves and not self.top[4] else None
        if not found:
            return super().parse_starttag(i)
        self._flush()
        markup, at = found[0], self.size
        tags = markup.count("<")
        self.size += 2 * tags - 1 - markup.count("><")  # and a text between two tags that do not touch
        self.rows.append([
            at, self.size - 1, at, "leaves", None, None, None, None, markup, "", None, at, self.top[3], self.top[5], None, None, False,
        ])
        return found.end()

    def _flush(self):
        if self.text:
            text = "".join(self.text)
            self.text = []
            self._add("raw" if self.top[4] else "text", text=text)

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("comment", before=f"<!--{data}-->", after="")

    def handle_starttag(self, tag, attrs):
        self._flush()
        role = cls = href = None
        before, after = f"<{tag}", ""
        for name, value in dict(attrs).items():
            value = value or ""
            if name == "href":
                href, before, after = value, before + ' href="', '"'
                continue
            if name == "role":
                role = value
            elif name == "class":
                cls = " ".join(value.split())
            shown = f' {name}="{escape(value)}"'
            if href is None:
                before += shown
            else:
                after += shown
        judged = tag in _JUDGED or bool(role or cls) or href is not None
        if tag in VOID_TAGS:
            self._add("void", tag, None, role, cls, href, before, after + "/>", judged=judged)
            return
        at = self.size
        _, block_tag, block, in_link, raw, within = self.top
        if tag in BLOCK_TAGS:
            block_tag, block = tag, at
        outer = self.top
        self.open[tag] += 1
        self.top = (
            tag, block_tag, block, in_link or tag == "a", raw or tag in RAW_TEXT_TAGS,
            (*within, at) if tag in CANDIDATE_TAGS else within,
        )
        self._add("open", tag, None, role, cls, href, before, after + ">", judged=judged)
        self.stack.append((self.rows[-1], outer))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_top()

    def handle_endtag(self, tag):
        self._flush()
        if self.open[tag]:
            while self._close_top() != tag:
                pass

    def _close_top(self):
        tag = self.top[0]
        row, outer = self.stack.pop()
        row[1] = self._add("close", tag, row[0], before=f"</{tag}>", after="", judged=row[-1])
        self.top = outer
        self.open[tag] -= 1
        return tag

    def page(self, html):
        self.feed(html)
        self.close()
        self._flush()
        while self.stack:
            self._close_top()
        return self.rows


_CHUNK = 50_000  # nodes in one batch
_PART_BYTES = 2 << 20  # of pages in one task: as nodes, they take up to a hundred times as much


def _nodes_of(page: str, leaves: bool = False) -> list[list]:
    """Node rows of a page; a page that the tokeniser refuses is one row of kind error with the reason."""
    try:
        return _PageReader(leaves).page(page)
    except (AssertionError, ValueError) as e:
        return [[0, 0, 0, "error", None, None, None, None, None, None, f"{type(e).__name__}: {e}", 0, False, (), None, None, True]]


_RUN = 4096  # nodes in one run
_SEPARATOR = "\0"  # between the texts of a run's nodes; a page that holds it is not packed
#: Of a run or of leaves: characters of its texts, each as `strip_ws` leaves it, and the number of those that are not blank.
_SIZES = (T.StructField("chars", T.IntegerType()), T.StructField("pieces", T.IntegerType()))


def _joined(field: str) -> bool:
    """Whether a run holds this field as one text; numbers and flags are arrays."""
    return isinstance(NODE[field].dataType, T.StringType)


def _measured(r: list) -> tuple[list[str], int]:
    """Words of a text or of leaves, and the number of their texts that are not blank."""
    kind = r[_AT["kind"]]
    if kind == "leaves":
        read = r[_AT["before"]]
        name = read[1:read.index(">")]
        # no leaf has a tag's signs in its text
        texts = _TAG.sub(">", read.replace(f"</{name}><{name}>", ">"))
        words = texts.replace(">", " ").split()
        return words, len(words) if len(texts.split()) == 1 else sum(map(bool, map(str.strip, texts.split(">"))))
    words = r[_AT["text"]].split() if kind == "text" else []
    return words, bool(words)


def _markup_of(r: list) -> str:
    """As `prune.node_markup`, of a node without href."""
    kind, text = r[_AT["kind"]], r[_AT["text"]]
    if kind == "leaves":
        return r[_AT["before"]].replace("&", "&amp;")
    return escape(text, quote=False) if kind == "text" else text if kind == "raw" else r[_AT["before"]] + r[_AT["after"]]


def _packed(part: list[list], texts: bool, whole: bool) -> list[list]:
    """Rows of a part of a page, with what no rule can part as one row of kind run.

    A node is removed with an element around it, so nodes go together unless a
    judged element begins or ends between them.  A run holds its nodes as a
    list.  With `texts`, it holds only its texts, and one without text is left
    out.  With `whole`, it has kind leaves, its markup in `before` and its words
    in `text`.
    """
    kind, text, before = _AT["kind"], _AT["text"], _AT["before"]
    rows, run = [], []

    def measured(nodes):
        words, pieces = [], 0
        for r in nodes:
            more, n = _measured(r)
            words += more
            pieces += n
        joined = " ".join(words)  # a word has a blank after it, but for the last of its text
        return joined, len(joined) + bool(words) - pieces, pieces

    def close():
        held = [r for r in run if r[kind] == "text"] if texts else list(run)
        if held:
            row = run[0][:-1]
            row[_AT["end_ord"]] = run[-1][_AT["end_ord" if run[-1][kind] == "leaves" else "ord"]]
            for name in ("tag", "role", "class", "href", "before", "after", "text", "block", "in_link", "parent", "grand"):
                row[_AT[name]] = None
            row[_AT["elem"]], row[kind] = row[_AT["ord"]], "run"
            words, *sizes = measured(run)
            if whole:
                row[kind], row[text], row[before], row[_AT["after"]] = "leaves", words, "".join(map(_markup_of, run)), ""
            rows.append([*row, *sizes, () if whole else held])
        run.clear()

    for r in part:
        free = not r[-1] and (whole or r[kind] != "leaves")
        if not free or len(run) == _RUN:
            close()
        if free:
            run.append(r)
        else:
            own = r[kind] == "leaves"
            rows.append([*r[:-1], *(measured([r])[1:] if own else (None, None)), ()])
            if own:
                rows[-1][before] = None if texts else _markup_of(r)
    close()
    return rows


def _tokenise(html: str, out: pa.Schema, inner: Sequence[str] = (), texts: bool = False, leaves: str | None = None,
              whole: bool = False):
    """Pages to nodes, in batches of bounded size however many nodes a page has."""
    def column(values, field):
        return pa.array(values, _ARROW_TYPES[NODE[field].dataType.typeName()])

    def held(runs, field):
        at = _AT[field]
        if _joined(field):
            return pa.array([_SEPARATOR.join([x[at] or "" for x in run]) for run in runs], pa.string())
        ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        return pa.ListArray.from_arrays(ends, column([x[at] for run in runs for x in run], field))

    def batch_of(source, rows, places):
        kept = [source.column(n).take(pa.array(places)) for n in source.schema.names if n not in (html, leaves)]
        own = [column([r[i] for r in rows], f.name) for i, f in enumerate(NODE.fields)]
        if inner:
            own += [pa.array([r[i] for r in rows], pa.int32()) for i in (-3, -2)]
            own.append(pa.StructArray.from_arrays([held([r[-1] for r in rows], n) for n in inner], list(inner)))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *own], out)], schema=out)

    def run(batches):
        for source in batches:
            rows, places, size = [], [], 0
            pages = source.column(html)
            for place in range(len(pages)):
                page = pages[place].as_py()
                single = not inner or _SEPARATOR in (page or "")
                alone = bool(leaves) and not single and source.column(leaves)[place].as_py()
                found = _nodes_of(page, alone) if page else []
                for k in range(0, len(found), _CHUNK):
                    part = found[k:k + _CHUNK]
                    last = part[-1]
                    size += last[1 if last[3] == "leaves" else 0] - part[0][0] + 1
                    made = part
                    if inner:
                        made = [[*r[:-1], None, None, ()] for r in part] if single else _packed(part, texts, whole and alone)
                    rows += made
                    places += [place] * len(made)
                    if size >= _CHUNK:
                        yield batch_of(source, rows, places)
                        rows, places, size = [], [], 0
            if rows:
                yield batch_of(source, rows, places)

    return run


def _parts(pages: DataFrame, html: str) -> int:
    """Tasks that the nodes of the pages are dealt over, so that what one of them sorts stays the same size."""
    spark = pages.sparkSession
    size = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // _PART_BYTES))


def _dealt(pages: DataFrame, key: str, html: str, keep: Sequence[str], errors: bool, inner: Sequence[str] = (),
           texts: bool = False, leaves: str | None = None, whole: bool = False) -> DataFrame:
    source = pages.select(key, *keep, html, *([leaves] if leaves else []))
    fields = [*(f for f in source.schema if f.name not in (html, leaves)), *NODE.fields]
    if inner:
        fields += _SIZES
        fields.append(T.StructField("inner", T.StructType([
            T.StructField(n, T.StringType() if _joined(n) else T.ArrayType(NODE[n].dataType)) for n in inner])))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    work = _tokenise(html, to_arrow_schema(schema), inner, texts, leaves, whole)
    nodes = source.mapInArrow(work, schema).repartition(_parts(source, html), key)
    return nodes if errors else nodes.where(F.col("kind") != "error")


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = (),
               errors: bool = False) -> DataFrame:
    """One row per node, dealt by page over tasks whose number follows the size of the pages; `key` must be unique per page.

    A page that cannot be tokenised has no nodes; with `errors`, it has one
    row of kind error whose text is the reason.
    """
    return _dealt(pages, key, html, keep, errors)


def packed_nodes(pages: DataFrame, key: str, html: str, keep: Sequence[str], fields: Sequence[str], texts: bool = False,
                 errors: bool = False, leaves: str | None = None, whole: bool = False) -> DataFrame:
    """As `html_nodes`, but nodes that pruning can only remove together are one row of kind run: what is shuffled
    and pruned follows the page's links and containers, not its words.

    Column `inner` holds the given fields of a run's nodes, with `texts` those
    of its texts only; `unpacked` gives them rows of their own again.

    `leaves` names a column that is true for pages whose key no other page has.
    Of those a stretch of block elements whose texts are all too short for a
    block, and which hold nothing else, is one row of kind leaves, also after
    `unpacked`, with its markup in `before` unless only texts are asked for.
    With `whole`, all their runs are such rows, with their words in `text`.
    Columns `chars` and `pieces` are the sizes of the texts of a run or of leaves.
    """
    return _dealt(pages, key, html, keep, errors, fields, texts, leaves, whole)


def of_run(nodes: DataFrame, field: str) -> Column:
    """One field of the nodes of a run, as an array."""
    if field not in nodes.schema["inner"].dataType.names:  # only texts are held
        return F.transform(of_run(nodes, "text"), lambda _: F.lit("text"))
    return F.split(F.col("inner")[field], _SEPARATOR) if _joined(field) else F.col("inner")[field]


def unpacked(nodes: DataFrame) -> DataFrame:
    """The nodes of runs as rows, all others as they are; in their task, no shuffle.  Fields that a run lacks are null."""
    held = nodes.schema["inner"].dataType.names
    own = [f for f in NODE.fields if f.name != "within"]

    def field(node, f):
        if f.name in held:
            return node[f"_{f.name}"].alias(f.name)
        return F.lit("text" if f.name == "kind" else None).cast(f.dataType).alias(f.name)

    split = nodes.withColumns({f"_{n}": of_run(nodes, n) for n in held})
    each = F.when(
        F.col("kind") == "run",
        F.transform(F.arrays_zip(*(f"_{n}" for n in held)), lambda x: F.struct(*(field(x, f) for f in own))),
    ).otherwise(F.array(F.struct(*(F.col(f.name) for f in own))))
    rest = [c for c in nodes.columns if c != "inner" and c not in {f.name for f in own}]
    return split.select(*rest, F.inline(each))


def is_element() -> Column:
    return F.col("kind").isin("open", "void")


def drop_subtrees(nodes: DataFrame, keys: Sequence[str], drop: Column) -> DataFrame:
    """Remove every element that satisfies `drop`, with all it contains."""
    so_far = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(is_element() & drop, F.col("end_ord"))).over(so_far)
    return (
        nodes.withColumn("_reach", F.coalesce(reach, F.lit(-1)))
        .where(F.col("_reach") < F.col("ord"))
        .drop("_reach")
    )
