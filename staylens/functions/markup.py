"""Elements of an HTML page as columns.

Spark has no reader for lenient HTML (its ``xpath`` functions fail on unclosed tags), so this is
the one place where rows go through Python: an Arrow function that walks a page once and returns
the texts and attributes asked for. It is a scalar function on purpose. Filters on other columns
then pass below it into the scan, which they would not with ``mapInPandas``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.text import as_column

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Tags whose text is not part of the page's text.
SILENT_TAGS = frozenset("script style template rt rp".split())
ASCII_BLANKS = " \n\t\f\r"


@dataclass(frozen=True)
class Field:
    """Text or attribute of the elements a selector finds; NULL if it finds none.

    An empty selector stands for the element of the enclosing group itself.
    ``text`` is ``outer`` (all text, ends stripped), ``nodes`` (every text node stripped, joined
    without separator), ``rendered`` (ends stripped, white space collapsed) or ``own`` (the first
    text node directly below the element). ``many`` keeps all elements instead of the first;
    ``leaf`` leaves out elements that contain another match.
    """

    selector: str
    text: str = "outer"
    attr: str | None = None
    many: bool = False
    leaf: bool = False


@dataclass(frozen=True)
class Group:
    """Fields read inside every element a selector finds: an array of structs."""

    selector: str
    fields: Mapping[str, Field | Group]


_NOTHING: Mapping[str, str] = {}
_NONE: frozenset[int] = frozenset()
#: What is between the angles of a tag that has only a name and quoted attributes without entities.
_PLAIN = re.compile(
    r"""([a-zA-Z][a-zA-Z0-9-]*)((?:[ \n\t\f\r]+[a-zA-Z][a-zA-Z0-9_:.-]*="[^"<>&]*")*)[ \n\t\f\r]*"""
    r"""|/([a-zA-Z][a-zA-Z0-9-]*)[ \n\t\f\r]*"""
)
_PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:.-]*)="([^"]*)\"""")
#: Tags whose content is not markup to some parsers.
_SPECIAL_TAGS = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript plaintext svg math".split()
)
_VERBATIM_TAGS = frozenset(("pre", "textarea"))
_RARE_TAGS = SILENT_TAGS | _VERBATIM_TAGS
#: Different tags, as written, that are remembered before a reader starts anew, and the longest of them.
_KNOWN_TAGS = 20_000
_KNOWN_LENGTH = 500


@dataclass(slots=True)
class _Tag:
    """A tag as written, and the steps of the reader's selectors that accept it."""

    name: str
    attrs: Mapping[str, str]
    accepted: frozenset[int]
    ends: bool = False
    rare: bool = False
    void: bool = False


class _Selectors:
    """The steps of all selectors of a reader by number, and the tags it has met.

    Attributes are kept for the tags in ``named`` alone (``None``: for all).
    """

    def __init__(self, columns: Sequence[_Values | _Structs] = ()) -> None:
        tags = {tag for column in columns for tag in column.named("")}
        self.named = None if not columns or tags & {"", "*"} else frozenset(tags)
        self._steps: dict[_Step, int] = {}
        self._of_tag: dict[str, list[tuple[_Step, int]]] = {}
        for column in columns:
            column.number(self)
        self.known: dict[str, _Tag | None] = {}

    def numbered(self, steps: Sequence[_Step]) -> list[tuple[int, bool, bool]]:
        """For each step its number, whether it must be a first child, and whether it is a child of the one before."""
        return [(self._steps.setdefault(step, len(self._steps)), step.first_child, step.direct) for step in steps]

    def attributes(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> Mapping[str, str]:
        if not attrs or not (self.named is None or tag in self.named):
            return _NOTHING
        return {name: value or "" for name, value in attrs}

    def accepted(self, tag: str, attrs: Mapping[str, str]) -> frozenset[int]:
        steps = self._of_tag.get(tag)
        if steps is None:
            steps = [(step, number) for step, number in self._steps.items() if step.tag in ("", "*", tag)]
            if len(self._of_tag) < _KNOWN_TAGS:
                self._of_tag[tag] = steps
        return frozenset([number for step, number in steps if step.accepts(attrs)]) if steps else _NONE

    def tag(self, written: str) -> _Tag | None:
        """The tag with this between its angles, to be ``known``; None if the standard parser has to read it."""
        found = _PLAIN.fullmatch(written)
        name = found and (found[1] or found[3]).lower()
        if name is None or name in _SPECIAL_TAGS:
            tag = None
        else:
            kept = found[2] and (self.named is None or name in self.named)
            pairs = [(n.lower(), v) for n, v in _PLAIN_ATTRIBUTE.findall(found[2])] if kept else ()
            attrs = self.attributes(name, pairs)
            ends = found[3] is not None
            accepted = _NONE if ends else self.accepted(name, attrs)
            tag = _Tag(name, attrs, accepted, ends, name in _RARE_TAGS, name in VOID_TAGS)
        if len(written) <= _KNOWN_LENGTH:
            if len(self.known) >= _KNOWN_TAGS:
                self.known.clear()
            self.known[written] = tag
        return tag


class _Page(HTMLParser):
    """Elements of a page in document order, with the ranges of texts and elements below them."""

    def __init__(self, html: str, selectors: _Selectors | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self._selectors = selectors or _Selectors()
        #: Elements that each step accepts.
        self.found: dict[int, list[int]] = {}
        self.elements: list[_Tag] = []
        self.parents: list[int] = []
        self.starts: list[int] = []  # first text below the element
        self.ends: list[int] = []  # end of these texts
        self.bounds: list[int] = []  # end of the elements below it
        self.texts: list[str] = []
        self.own_text: dict[int, int] = {}
        self._open: list[int] = []
        self._open_names: list[str] = []
        self._open_tags: Counter[str] = Counter()
        self._silent = self._verbatim = 0
        self._cut = True
        self._blank: list[int] = []  # texts that may be white space only
        self._take(html)
        self.close()
        while self._open:
            self._end_innermost()
        for index in self._blank:
            text = self.texts[index]
            if not text.strip(ASCII_BLANKS):
                self.texts[index] = "\n" if "\n" in text else " "

    @property
    def tags(self) -> list[str]:
        return [tag.name for tag in self.elements]

    @property
    def attrs(self) -> list[Mapping[str, str]]:
        return [tag.attrs for tag in self.elements]

    @property
    def is_first(self) -> list[bool]:
        """The first child is the element that begins next after its parent."""
        return [parent == node - 1 for node, parent in enumerate(self.parents)]

    @property
    def spans(self) -> list[list[int]]:
        """For each element its first text, the end of its texts and the end of the elements below it."""
        return [list(span) for span in zip(self.starts, self.ends, self.bounds)]

    def _take(self, html: str) -> None:
        """Plain tags and the texts before them at once, everything else by the standard parser.

        The loop does what the handlers below do, for tags that need no more than this.
        """
        find, known, tag_of = html.find, self._selectors.known, self._selectors.tag
        parents, starts, ends, bounds = self.parents, self.starts, self.ends, self.bounds
        texts, own_text, elements, found = self.texts, self.own_text, self.elements, self.found
        opened, names, counts = self._open, self._open_names, self._open_tags
        at, size = 0, len(html)
        while at < size:
            left = find("<", at)
            right = find(">", left) if left >= 0 else -1
            written = html[left + 1 : right] if right >= 0 else ""
            tag = known.get(written) or tag_of(written)
            if tag is None:
                at = self._take_other(html, at)
                continue
            if left > at:
                text = html[at:left]
                if "&" in text:
                    text = unescape(text)
                if self._cut and not self._silent:
                    if opened:
                        own_text.setdefault(opened[-1], len(texts))
                    if not self._verbatim and text[:1] in ASCII_BLANKS:
                        self._blank.append(len(texts))
                    texts.append(text)
                else:
                    self.handle_data(text)
            self._cut = True
            at = right + 1
            name = tag.name
            if tag.ends:
                if names and names[-1] == name and not tag.rare:
                    names.pop()
                    counts[name] -= 1
                    node = opened.pop()
                    ends[node] = len(texts)
                    bounds[node] = len(parents)
                else:
                    self.handle_endtag(name)
            elif tag.rare:
                self._start(tag)
            else:
                node, first = len(parents), len(texts)
                parents.append(opened[-1] if opened else -1)
                elements.append(tag)
                for step in tag.accepted:
                    if step in found:
                        found[step].append(node)
                    else:
                        found[step] = [node]
                starts.append(first)
                ends.append(first)
                bounds.append(node + 1)
                if not tag.void:
                    opened.append(node)
                    names.append(name)
                    counts[name] += 1

    def _take_other(self, html: str, start: int) -> int:
        """What stands here goes to the standard parser, in growing pieces until nothing is left open."""
        size, at = 1, start
        while at < len(html):
            end = html.find(">", start + size) + 1 or len(html)
            self.feed(html[at:end])
            at = end
            if not self.rawdata and self.cdata_elem is None:
                break
            size = 2 * (at - start)
        return at

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kept = self._selectors.attributes(tag, attrs)
        self._start(_Tag(tag, kept, self._selectors.accepted(tag, kept)))

    def _start(self, element: _Tag) -> None:
        tag = element.name
        node, texts = len(self.parents), len(self.texts)
        self.parents.append(self._open[-1] if self._open else -1)
        self.elements.append(element)
        for step in element.accepted:
            self.found.setdefault(step, []).append(node)
        self.starts.append(texts)
        self.ends.append(texts)
        self.bounds.append(node + 1)
        self._cut = True
        if tag not in VOID_TAGS:
            self._open.append(node)
            self._open_names.append(tag)
            self._open_tags[tag] += 1
            self._silent += tag in SILENT_TAGS
            self._verbatim += tag in _VERBATIM_TAGS

    def handle_endtag(self, tag: str) -> None:
        self._cut = True
        if self._open_tags[tag]:
            while self._end_innermost() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if self._cut:
            if self._open:
                self.own_text.setdefault(self._open[-1], len(self.texts))
            if not self._verbatim and data[:1] in ASCII_BLANKS:
                self._blank.append(len(self.texts))
            self.texts.append(data)
            self._cut = False
        else:
            self.texts[-1] += data

    def handle_comment(self, data: str) -> None:
        self._cut = True

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _end_innermost(self) -> str:
        node = self._open.pop()
        tag = self._open_names.pop()
        self._open_tags[tag] -= 1
        self._silent -= tag in SILENT_TAGS
        self._verbatim -= tag in _VERBATIM_TAGS
        self.ends[node] = len(self.texts)
        self.bounds[node] = len(self.parents)
        return tag

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def find(self, selector: list[tuple[int, bool, bool]], within: int) -> Sequence[int]:
        nodes = self.found.get(selector[-1][0])
        if nodes is None:
            return ()
        if within >= 0:
            nodes = nodes[bisect_left(nodes, within + 1) : bisect_left(nodes, self.bounds[within])]
        if len(selector) == 1 and not selector[0][1]:
            return nodes
        return [node for node in nodes if self._matches(node, selector)]

    def _matches(self, node: int, selector: list[tuple[int, bool, bool]]) -> bool:
        *outer, (step, first_child, direct) = selector
        above = self.parents[node]
        if step not in self.elements[node].accepted or (first_child and above != node - 1):
            return False
        while outer and above >= 0:
            if self._matches(above, outer):
                return True
            if direct:
                return False
            above = self.parents[above]
        return not outer

    def value(self, node: int, field: Field) -> str:
        if field.attr is not None:
            return self.elements[node].attrs.get(field.attr, "")
        if field.text == "own":
            index = self.own_text.get(node)
            return "" if index is None else self.texts[index]
        texts = self.texts[self.starts[node] : self.ends[node]]
        if field.text == "nodes":
            return "".join(text.strip() for text in texts)
        whole = "".join(texts)
        return " ".join(whole.split()) if field.text == "rendered" else whole.strip()


@dataclass(frozen=True)
class _Step:
    """One compound of a selector: tag, classes, attribute tests, position, link to the left."""

    tag: str
    classes: tuple[str, ...]
    tests: tuple[tuple[str, str, str], ...]
    first_child: bool
    direct: bool

    def accepts(self, attrs: Mapping[str, str]) -> bool:
        """Whether an element of this tag with these attributes fits, its place left aside."""
        if self.classes and not set(self.classes) <= set(attrs.get("class", "").split()):
            return False
        for name, operator, value in self.tests:
            if name not in attrs:
                return False
            if operator == "=" and attrs[name] != value:
                return False
            if operator == "*=" and value not in attrs[name]:
                return False
        return True


_COMPOUND = re.compile(
    r"""\s*(?P<direct>>?)\s*(?P<tag>[a-zA-Z][\w-]*|\*)?"""
    r"""(?P<rest>(?:\.[\w-]+|\[[\w-]+(?:\*?=(?:"[^"]*"|'[^']*'))?\]|:first-child)*)"""
)
_ATTRIBUTE = re.compile(r"""\[([\w-]+)(?:(\*?=)(?:"([^"]*)"|'([^']*)'))?\]""")


def _steps(selector: str) -> list[_Step]:
    """Compounds of a selector: tag, class, attribute, first child, descendant and child."""
    steps, position = [], 0
    while position < len(selector):
        found = _COMPOUND.match(selector, position)
        if found.end() == position or not (found["tag"] or found["rest"]):
            raise ValueError(f"selector not supported: {selector}")
        plain = _ATTRIBUTE.sub("", found["rest"])
        steps.append(
            _Step(
                tag=(found["tag"] or "").lower(),
                classes=tuple(re.findall(r"\.([\w-]+)", plain)),
                tests=tuple(
                    (name, operator, double or single)
                    for name, operator, double, single in _ATTRIBUTE.findall(found["rest"])
                ),
                first_child=":first-child" in plain,
                direct=bool(found["direct"]),
            )
        )
        position = found.end()
    return steps


class _Values:
    """A field over the pages of a batch: texts end to end and, if it is ``many``, where lists begin."""

    def __init__(self, field: Field) -> None:
        self.field, self.steps = field, _steps(field.selector)
        self.selector: list[tuple[int, bool, bool]] = []
        self.values: list[str | None] = []
        self.starts: list[int | None] = [0]

    def number(self, selectors: _Selectors) -> None:
        self.selector = selectors.numbered(self.steps)

    def add(self, page: _Page, within: int) -> None:
        field = self.field
        nodes = page.find(self.selector, within) if self.steps else [within]
        if field.leaf:
            following = [*nodes[1:], len(page.parents)]
            nodes = [n for n, after in zip(nodes, following) if after >= page.bounds[n]]
        if field.many:
            self.values += [page.value(node, field) for node in nodes]
            self.starts.append(len(self.values))
        else:
            self.values.append(page.value(nodes[0], field) if nodes else None)

    def add_null(self) -> None:
        if self.field.many:
            self.starts[-1] = None
            self.starts.append(len(self.values))
        else:
            self.values.append(None)

    def array(self) -> pa.Array:
        texts = pa.array(self.values, pa.string())
        return pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), texts) if self.field.many else texts

    def named(self, around: str) -> Iterator[str]:
        yield from _tags_with_attributes(self.steps)
        if self.field.attr is not None:
            yield self.steps[-1].tag if self.steps else around


class _Structs:
    """A group over the pages of a batch: its fields' columns and where each page's elements begin."""

    def __init__(self, group: Group) -> None:
        self.steps = _steps(group.selector)
        self.selector: list[tuple[int, bool, bool]] = []
        self.parts = {name: _column(part) for name, part in group.fields.items()}
        self.starts: list[int | None] = [0]
        self.total = 0

    def number(self, selectors: _Selectors) -> None:
        self.selector = selectors.numbered(self.steps)
        for part in self.parts.values():
            part.number(selectors)

    def add(self, page: _Page, within: int) -> None:
        nodes = page.find(self.selector, within)
        for part in self.parts.values():
            for node in nodes:
                part.add(page, node)
        self.total += len(nodes)
        self.starts.append(self.total)

    def add_null(self) -> None:
        self.starts[-1] = None
        self.starts.append(self.total)

    def array(self) -> pa.Array:
        structs = pa.StructArray.from_arrays([p.array() for p in self.parts.values()], list(self.parts))
        return pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), structs)

    def named(self, around: str) -> Iterator[str]:
        yield from _tags_with_attributes(self.steps)
        for part in self.parts.values():
            yield from part.named(self.steps[-1].tag)


def _column(part: Field | Group) -> _Values | _Structs:
    return _Values(part) if isinstance(part, Field) else _Structs(part)


def _tags_with_attributes(steps: Sequence[_Step]) -> Iterator[str]:
    """Tags whose attributes a selector looks at; empty or a star for those of any tag."""
    return (step.tag for step in steps if step.classes or step.tests)


def _spark_type(part: Field | Group) -> str:
    if isinstance(part, Group):
        inner = ", ".join(f"{name}: {_spark_type(p)}" for name, p in part.fields.items())
        return f"array<struct<{inner}>>"
    return "array<string>" if part.many else "string"


def read_markup(html: Column | str, shape: Mapping[str, Field | Group]) -> Column:
    """Struct with one field per entry of ``shape``, and ``error`` for a page that broke the reader.

    A NULL page gives NULL. Read a part of the result and explode it in the same ``select``:
    naming the struct first lets the optimizer add a filter that runs the function a second time.
    """
    shape = dict(shape)
    types = [*(f"{name}: {_spark_type(part)}" for name, part in shape.items()), "error: string"]

    @F.arrow_udf(f"struct<{', '.join(types)}>")
    def markup(pages: pa.Array) -> pa.Array:
        columns = {name: _column(part) for name, part in shape.items()}
        selectors = _Selectors(list(columns.values()))
        errors: list[str | None] = []
        for html in pages.to_pylist():
            page = None
            try:
                page = None if html is None else _Page(html, selectors)
                errors.append(None)
            except AssertionError as error:  # raised by the standard parser on broken sections
                errors.append(str(error))
            for column in columns.values():
                if page is None:
                    column.add_null()
                else:
                    column.add(page, -1)
        arrays = [*(column.array() for column in columns.values()), pa.array(errors, pa.string())]
        return pa.StructArray.from_arrays(arrays, [*shape, "error"], mask=pages.is_null())

    return markup(as_column(html))
