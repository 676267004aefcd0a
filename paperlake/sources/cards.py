"""Cards of listing pages by a tag stack, as a table function over the markup.

A rule says which elements are cards and which elements inside them are fields.  Cards may
lie inside cards; a field belongs to the innermost card that is open.  End tags that are
missing are added where markup allows them to be left out, end tags without a start are
ignored, and whatever else is still open when an outer element ends, or the page, ends there
and is marked.  Comments, scripts and styles are no text.

Defined results: null markup and pages without a card give no row; a field that is not found
is missing from the map, one that is empty is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Elements without content and end tag (fixed values of the markup language).
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open paragraph (fixed values of the markup language).
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Start tags that end open elements of some names, unless one of the others is in between.
_ENDS = {
    **{b: ({"p"}, {"article", "div", "li", "section", "td"} - {b}) for b in _BLOCKS},
    "li": ({"li"}, {"ol", "ul"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
_NO_TEXT = frozenset(("script", "style", "template"))


@dataclass(frozen=True)
class Select:
    """Elements of a tag, a class, a part of the class attribute or an attribute's value; all
    that are given must hold."""

    tag: str | None = None
    css_class: str | None = None
    class_part: str | None = None
    attribute: tuple[str, str] | None = None

    def holds(self, tag: str, attributes: dict[str, str]) -> bool:
        classes = attributes.get("class", "")
        return (
            (self.tag is None or tag == self.tag) and (self.css_class is None or self.css_class in classes.split())
            and (self.class_part is None or self.class_part in classes.lower()) and (self.attribute is None or attributes.get(self.attribute[0]) == self.attribute[1])
        )


@dataclass(frozen=True)
class Rule:
    """``fields``: selections by name, or ``@name`` for an attribute's value of them;
    ``required``: fields without which a card has a problem."""

    card: Select
    fields: dict[str, Select] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Rule:
        d = json.loads(text)
        select = lambda s: Select(**s | {"attribute": tuple(s["attribute"]) if s["attribute"] else None})
        return cls(select(d["card"]), {k: select(s) for k, s in d["fields"].items()}, tuple(d["required"]))


@dataclass
class _Card:
    number: int
    parent: int | None
    depth: int
    fields: dict[str, list[str]] = field(default_factory=dict)
    problem: str | None = None
    whole: bool = False


class _Parser(HTMLParser):
    def __init__(self, rule: Rule) -> None:
        super().__init__(convert_charrefs=True)
        self.rule = rule
        self.stack: list[str] = []
        self.cards: list[_Card] = []
        self.open: list[_Card] = []
        self.captures: list[tuple[int, _Card, str, list[str]]] = []  # depth, card, field, text
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, walls = _ENDS.get(tag, ((), ()))
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in ended:
                self._close(k, True)
                break
            if self.stack[k] in walls:
                break
        attributes = {k.lower(): v or "" for k, v in attrs}
        self.stack.append(tag)
        depth = len(self.stack)
        if tag in _NO_TEXT:
            self.silent += 1
        if self.rule.card.holds(tag, attributes):
            card = _Card(len(self.cards), self.open[-1].number if self.open else None, depth)
            self.cards.append(card)
            self.open.append(card)
        elif self.open:
            card = self.open[-1]
            for name, wanted in self.rule.fields.items():
                key, _, attribute = name.partition("@")
                if wanted.holds(tag, attributes):
                    if attribute:
                        if attributes.get(attribute):
                            card.fields.setdefault(key, []).append(attributes[attribute])
                    else:
                        if any(c is card for _, c, _, _ in self.captures):
                            card.problem = card.problem or f"field {key} inside a field"
                        self.captures.append((depth, card, key, []))
        if tag in _VOID:
            self._close(depth - 1, True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack and self.stack[-1] == tag:
            self._close(len(self.stack) - 1, True)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                self._close(k, True)
                return

    def handle_data(self, data: str) -> None:
        if self.open and not self.silent:
            for _, card, _, text in self.captures:
                if card is self.open[-1]:
                    text.append(data)

    def _close(self, k: int, ended: bool) -> None:
        """Ends the open elements from the k-th on; ``ended``: that one has its end."""
        while len(self.stack) > k:
            depth, tag = len(self.stack), self.stack.pop()
            self.silent -= tag in _NO_TEXT
            while self.captures and self.captures[-1][0] == depth:
                _, card, name, text = self.captures.pop()
                value = " ".join("".join(text).split())
                if value:
                    card.fields.setdefault(name, []).append(value)
            if self.open and self.open[-1].depth == depth:
                card = self.open.pop()
                card.whole = ended and depth == k + 1
                missing = [f for f in self.rule.required if f not in card.fields]
                card.problem = card.problem or (f"no {missing[0]}" if missing else None if card.whole else "no end")

    def finish(self) -> list[_Card]:
        self.close()
        self._close(0, False)
        return self.cards


def parse(html: str, rule: Rule) -> list[_Card]:
    parser = _Parser(rule)
    parser.feed(html)
    return parser.finish()


@udtf(returnType="card int, parent int, whole boolean, problem string, fields map<string, array<string>>")
class Cards:
    """Rows for each card of a page: number, the card it lies in, whether its end was there,
    what is wrong with it, and its fields' texts."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def eval(self, html: str, rule: str) -> Iterator[tuple]:
        if html is None:
            return
        if rule not in self.rules:
            self.rules[rule] = Rule.of(rule)
        for c in parse(html, self.rules[rule]):
            yield c.number, c.parent, c.whole, c.problem, c.fields


def cards(pages: DataFrame, rule: Rule, html: str = "html") -> DataFrame:
    """The pages' columns but the markup, with a row for each of their cards."""
    kept = [c for c in pages.columns if c != html]
    found = Cards(F.col(html).outer(), F.lit(rule.text()))
    return pages.lateralJoin(found).select(*kept, "card", "parent", "whole", "problem", "fields")


def one(name: str) -> Column:
    """The first text of a field of a card."""
    return F.get(F.col("fields")[name], F.lit(0))


def without_problems(found: DataFrame) -> DataFrame:
    """The cards; one with a problem stops the run."""
    stop = F.raise_error(F.concat(F.lit("card "), F.col("card").cast("string"), F.lit(": "), F.col("problem"))).cast("int")
    return found.withColumn("card", F.when(F.col("problem").isNull(), F.col("card")).otherwise(stop))
