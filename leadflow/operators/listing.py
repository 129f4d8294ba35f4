"""Category listing pages read into products: one Arrow pass per page, products as a list column."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions.html import Node, read_page

PRODUCT = "struct<pos:int,name:string,slug:string,g2_url:string,website:string,rating:double,review_count:bigint>"


@dataclass(frozen=True)
class Mark:
    """How an element is told: tag, class, attribute, what the attribute is or holds, an element around it."""

    tag: str = ""
    css: str = ""
    attr: str = ""
    equals: str | None = None
    holds: str = ""
    inside: str = ""
    any_case: bool = False

    def fits(self, node: Node) -> bool:
        if (self.tag and node.tag != self.tag) or (self.css and not node.has_class(self.css)):
            return False
        if not self.attr:
            return True
        value = node.attrs.get(self.attr)
        if value is None:
            return False
        value = value.lower() if self.any_case else value
        return self.holds in value and self.equals in (None, value)

    def all(self, root: Node) -> list[Node]:
        if not self.inside:
            return root.find_all(self.fits)
        boxes = root.find_all(lambda n: n.tag == self.inside or n.has_class(self.inside))
        return [n for box in boxes for n in box.find_all(self.fits)]


# The marks of a listing, each line in the order in which they are tried.
CARDS = (Mark(css="product-card"), Mark(attr="data-product-id"), Mark(css="product-listing__card"), Mark(css="paper--product"))
PLACES = {
    "name": (
        Mark(attr="itemprop", equals="name"), Mark(css="product-card__product-name"), Mark(tag="a", css="product-listing__product-name"),
        Mark(tag="a", inside="h3"),
    ),
    "picture": (Mark(tag="img", attr="alt"),),
    "link": (Mark(tag="a", css="product-card__img", attr="href"), Mark(tag="a", css="product-listing__product-name", attr="href")),
    "rating": (Mark(attr="itemprop", equals="ratingValue"), Mark(css="star-wrapper__value")),
    "reviews": (Mark(attr="itemprop", equals="reviewCount"), Mark(css="product-listing__review-count")),
    "website": (Mark(tag="a", attr="href", holds="visit_website"), Mark(css="product-listing__website")),
}
PAGE_LINKS = (
    Mark(tag="a", attr="aria-label", holds="Page"), Mark(tag="a", attr="aria-label", holds="page"), Mark(tag="a", inside="pagination"),
    Mark(tag="nav", attr="aria-label", holds="pagination", any_case=True), Mark(tag="a", attr="data-pagination"),
    Mark(tag="a", attr="href", holds="page="),
)
# in the place itself, then anywhere in the card
NUMBERS: dict[str, tuple[Callable, str, str]] = {
    "rating": (float, r"^\s*([\d.]+)\s*$", r"(\d\.\d)\s*out of 5"),
    "reviews": (int, r"([\d,]+)", r"\(([\d,]+)\)"),
}


def _tried(root: Node, marks: Sequence[Mark]) -> list[Node]:
    """What the first mark that finds something finds."""
    return next((found for mark in marks if (found := mark.all(root))), [])


def _said(node: Node | None) -> str:
    return "" if node is None else node.attrs.get("content") or "".join(node.strings())


def _number(kind: Callable, pattern: str, text: str):
    hit = re.search(pattern, text)
    try:
        return kind(hit.group(1).replace(",", "")) if hit else None
    except ValueError:
        return None


def _slug(link: Node | None) -> str:
    path = urlparse(link.attrs.get("href", "")).path if link is not None else ""
    hit = re.match(r"/*products/([^/]+)", path)
    return hit.group(1) if hit else ""


def _site(link: Node | None) -> str | None:
    address = link.attrs.get("href", "") if link is not None else ""
    behind = parse_qs(urlparse(address).query).get("url")
    address = behind[0] if behind else address
    return urlparse(address).netloc.removeprefix("www.") if address.startswith("http") else None


def _product(card: Node) -> dict | None:
    at = {field: next(iter(_tried(card, marks)), None) for field, marks in PLACES.items()}
    name = "".join(at["name"].strings()) if at["name"] is not None else ""
    name = name or (at["picture"].attrs["alt"].strip() if at["picture"] is not None else "")
    link = at["link"] if at["link"] is not None else at["name"]
    slug = _slug(link)
    if len(name) < 2 or not slug:
        return None
    text = " ".join(card.strings())
    numbers = {}
    for field, (kind, own, around) in NUMBERS.items():
        value = _number(kind, own, _said(at[field]))
        numbers[field] = _number(kind, around, text) if value is None else value
    return {
        "name": name, "slug": slug, "g2_url": f"https://www.g2.com/products/{slug}", "website": _site(at["website"]),
        "rating": numbers["rating"], "review_count": numbers["reviews"],
    }


def _page_count(page: Node) -> int:
    found = _tried(page, PAGE_LINKS)
    links = [a for n in found for a in ([n] if n.tag == "a" else n.find_all(lambda x: x.tag == "a"))]
    numbers = [_number(int, r"^\s*(\d+)\s*$", "".join(a.strings())) or _number(int, r"[?&]page=(\d+)", a.attrs.get("href", "")) for a in links]
    return max([1, *(n for n in numbers if n)])


def read_listings(pages: DataFrame) -> DataFrame:
    """(category, page, page_count, n_cards, products) of listing pages (category, page, html), each parsed once.

    Store the result where both products and page counts are wanted. Pages that are read already stay as they are.
    """
    if "products" in pages.columns:
        return pages

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for category, number, html in zip(batch["category"], batch["page"], batch["html"]):
                page = read_page(html)
                cards = _tried(page, CARDS)
                products = [p for p in map(_product, cards) if p]
                out.append([category, number, _page_count(page), len(cards), [{"pos": i, **p} for i, p in enumerate(products)]])
            yield pd.DataFrame(out, columns=["category", "page", "page_count", "n_cards", "products"])

    schema = f"category string, page int, page_count int, n_cards int, products array<{PRODUCT}>"
    return pages.select("category", F.col("page").cast("int").alias("page"), "html").mapInPandas(rows, schema)


def listing_products(pages: DataFrame) -> DataFrame:
    """Products of listing pages, in page order; takes pages or what ``read_listings`` made of them."""
    return read_listings(pages).select("category", "page", F.inline("products"))


def listing_page_count(pages: DataFrame) -> DataFrame:
    """Known number of pages per fetched listing page; 1 when the page does not tell."""
    return read_listings(pages).select("category", "page", "page_count", "n_cards")
