"""Text, images and links of web pages by Spark's own regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts without content, paragraphs, links, images and marks of decoration.
CHROME = r"(?is)<(?:nav|header|footer|script|style|aside)\b.*?</(?:nav|header|footer|script|style|aside)\s*>"
MAIN = r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)\s*>"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|$)"
LINK = r"(?is)(<a\b[^>]*\bhref=\"[^\"]*\"[^>]*>.*?</a>)"
TAG = r"(?s)<[^>]*>"
IMAGE = r"(?is)(<img\b[^>]*>)"
DECORATION = ("logo", "icon", "banner", "button", "arrow", "nav", "sprite", "avatar", "badge", "flag", "pixel", "spacer", "tracker", "ad[-_]", "advert", "widget")


def page_text(html: Column) -> Column:
    """Paragraphs of the article (else of the page) without navigation and the like, blank lines between; null if none."""
    bare = F.regexp_replace(html, CHROME, " ")
    main = F.regexp_extract(bare, MAIN, 1)
    body = F.when(main != "", main).otherwise(bare)
    texts = F.transform(F.regexp_extract_all(body, F.lit(PARAGRAPH), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, TAG, " "), r"\s+", " ")))
    return F.nullif(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path from the root with its steps ``.`` and ``..`` taken; ``..`` at the root stays there."""
    steps = F.split(F.substring(path, 2, 1_000_000), "/")
    ends_in_folder = F.element_at(steps, -1).isin(".", "..")
    back = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", back(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(ends_in_folder & (F.size(walked) > 0), "/").otherwise(""))


def absolute(base: Column, reference: Column) -> Column:
    """The address that a reference on the page ``base`` means: whole ones as they are, else by host, root or folder."""
    origin, scheme = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?:)", 1)
    page, query = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1), F.regexp_extract(base, r"^([^#]*)", 1)
    path, rest = F.regexp_extract(reference, r"^([^?#]*)", 1), F.regexp_extract(reference, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(page, r"^/(.*/)?", 1))
    return (
        F.when(F.rlike(reference, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), reference)
        .when(F.startswith(reference, F.lit("//")), F.concat(scheme, reference))
        .when(F.startswith(reference, F.lit("/")), F.concat(origin, without_dots(path), rest))
        .when(F.startswith(reference, F.lit("?")), F.concat(origin, page, reference))
        .when(F.startswith(reference, F.lit("#")), F.concat(query, reference))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


def page_images(pages: DataFrame, key: str, html: str, url: str, most: int = 3) -> DataFrame:
    """``key, place, image``: content images as absolute addresses, each once, the first ``most`` of a page.

    No content: inline data, drawings (``.svg``), images said to be under 80 wide or high, and those with a mark of
    decoration anywhere in their absolute address, without regard to case.
    """
    tags = pages.select(key, F.col(url).alias("_url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(IMAGE), F.lit(1))).alias("_k", "_tag"))
    known = lambda pattern: F.nullif(F.regexp_extract("_tag", pattern, 1), F.lit(""))
    attribute = lambda n: F.coalesce(known(rf"(?i)\s{n}\s*=\s*[\"']([^\"']*)"), known(rf"(?i)\s{n}\s*=\s*([^\"'\s>]+)"))
    source = F.coalesce(attribute("src"), attribute("data-src"))
    small = F.coalesce(attribute("width").try_cast("int") < 80, F.lit(False)) | F.coalesce(attribute("height").try_cast("int") < 80, F.lit(False))
    kept = tags.withColumn("_src", source).filter(F.col("_src").isNotNull() & ~small & ~F.lower("_src").rlike(r"^data:|\.svg$"))
    found = kept.withColumn("image", absolute(F.col("_url"), F.col("_src"))).filter(~F.lower("image").rlike("|".join(DECORATION)))
    once = found.groupBy(key, "image").agg(F.min("_k").alias("_k"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_k"))).filter(F.col("place") <= most).select(key, "place", "image")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, place, text, href`` of all links with a text, in order."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("place", "_tag"))
    text = F.trim(F.regexp_replace(F.regexp_replace("_tag", TAG, " "), r"\s+", " "))
    return tags.select(key, "place", text.alias("text"), F.regexp_extract("_tag", r"(?i)\bhref=\"([^\"]*)\"", 1).alias("href")).filter("text <> ''")


def link_index(found: DataFrame, order: list[str], last: bool = True, binomial: bool = False) -> DataFrame:
    """``name, href``: one address per link text (lower case), of the last link, or the first.

    ``binomial`` takes the leading two words as the name, if the first is capitalised and the second is not.
    """
    name = F.regexp_extract("text", r"^([A-Z][a-z]+ [a-z]+)", 1) if binomial else F.col("text")
    keyed = found.withColumn("name", F.lower(name)).filter("name <> ''")
    # an aggregate, so that a name that every page has is reduced before the shuffle
    pick = F.max_by if last else F.min_by
    return keyed.groupBy("name").agg(pick("href", F.struct(*order)).alias("href"))


def resolve_with_aliases(names: DataFrame, index: DataFrame) -> DataFrame:
    """``id, href``: the first of an entity's names (``id, place, name``; the canonical one is place 0) in the index."""
    met = names.select("id", "place", F.lower("name").alias("name")).join(index, "name")
    return met.groupBy("id").agg(F.min_by("href", "place").alias("href"))
