"""Interactive elements of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.functions.ids import element_id
from friction.functions.tables import spread

#: Tags of interactive elements, attributes, mount points of shells, reactive attributes.
TAG = r"(?i)<(button|input|textarea|select|form|a)\b([^>]*)>"
ATTRIBUTE = r"""([:@a-zA-Z_][\w:.\-@]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
MOUNT = r"""(?i)<div[^>]+id=["'](?:root|app|__next|svelte)["']"""
MODULE = r"""(?i)<script[^>]+type=["']module["']"""
REACTIVE = r"""(?i)<([a-zA-Z][\w-]*)([^>]*?\b(?:hx-[a-z]+|x-on:[a-z]+|@[a-z]+|v-on:[a-z]+|on:[a-z]+|\(click\)|\(submit\))=[^>]*)>"""
HANDLERS = ("onclick", "onsubmit", "onchange", "oninput", "@click", "@submit", "@change", "@input", "v-on:click", "v-on:submit", "on:click", "on:submit", "x-on:click", "(click)", "(submit)")
INTERACTIVE = ("button", "input", "textarea", "select", "form", "a")
SPACES = r"[\s   -     　﻿]+"

#: Roles by the first words of a label, in the order they are tried.
ROLE_WORDS = (
    ("SUBMIT", r"submit|save|create|continue|next|sign\s?up|register|apply|send|publish|post"),
    ("CANCEL", r"cancel|close|discard|nevermind|back|skip"),
    ("DANGER", r"delete|remove|destroy|drop|wipe|clear|deactivate"),
    ("DISMISS", r"dismiss|close|×|✕|hide"),
    ("RETRY", r"retry|try again|reload|refresh"),
    ("HELP", r"help|support|contact|faq|docs|documentation"),
    ("SEARCH", r"search|find|lookup"),
    ("LOGIN", r"log\s?in|sign\s?in"),
    ("LOGOUT", r"log\s?out|sign\s?out"),
    ("PAYMENT", r"pay|checkout|purchase|buy"),
)
#: The words at the beginning of a label in templates, in the order in which they are tried, and the roles that
#: an element of a template can name itself.
TEMPLATE_WORDS = (
    ("SUBMIT", r"submit|save|create|continue|next|sign\s?up|register|apply|send|publish|post"),
    ("CANCEL", r"cancel|close|discard|nevermind|back|skip"),
    ("DANGER", r"delete|remove|destroy|drop|wipe|clear|deactivate"),
    ("DISMISS", r"dismiss|close|×|✕|hide"),
    ("RETRY", r"retry|try again|reload|refresh"),
    ("HELP", r"help|support|contact|faq|docs|documentation"),
    ("CONFIRM", r"confirm|yes|ok|agree|accept|approve"),
    ("SEARCH", r"search|find|lookup"),
    ("FILTER", r"filter|narrow|refine"),
    ("MENU", r"menu|more|options|⋮|☰"),
    ("EDIT", r"edit|rename|modify|change|update"),
    ("DELETE", r"delete|remove|trash|archive"),
    ("LOGIN", r"log\s?in|sign\s?in|authenticate"),
    ("LOGOUT", r"log\s?out|sign\s?out"),
    ("PAYMENT", r"pay|checkout|purchase|buy|complete\s+(order|purchase)"),
)
NAMED_ROLES = ("SUBMIT", "CANCEL", "DANGER", "PRIMARY", "SECONDARY", "DISMISS", "RETRY", "HELP", "CONFIRM", "SEARCH", "FILTER", "MENU", "EDIT", "DELETE", "LOGIN", "LOGOUT", "PAYMENT", "NAV", "TOGGLE", "EXPAND")
DESTRUCTIVE = ("DANGER", "DELETE", "LOGOUT")
SIGNS = "×✕⋮☰"


def begins_with(label: Column, words: str) -> Column:
    """Whether a label begins with one of the words, and the word ends there. After a sign, which is no letter, one must follow."""
    signs = "".join(c for c in SIGNS if c in words)
    plain_words = "|".join(w for w in words.split("|") if w not in SIGNS) if signs else words
    either = rf"(?:{plain_words})(?![A-Za-z0-9_])" + (rf"|[{signs}](?=[A-Za-z0-9_])" if signs else "")
    return F.trim(label).rlike(rf"(?i)^(?:{either})")


def semantic_role(tag: Column, kind: Column, href: Column, label: Column, css: Column, named: Column | None = None) -> Column:
    """What an element is for: by its type, its target, its label, its class; null if nothing says. named: what the element of a
    template calls itself, which comes after its type; templates know more words."""
    link = tag == "a"
    role = F.when(tag.isin("input", "button") & (kind == "submit"), "SUBMIT")
    if named is not None:
        role = role.when(F.upper(named).isin(*NAMED_ROLES), F.upper(named))
    role = role.when(link & href.isin("#help", "/help"), "HELP").when(link & href.isin("#search", "/search"), "SEARCH").when(link, "NAV")
    for name, words in ROLE_WORDS if named is None else TEMPLATE_WORDS:
        role = role.when(begins_with(label, words), name)
    css = F.lower(F.coalesce(css, F.lit("")))
    return role.when(css.contains("danger") | css.contains("destructive"), "DANGER").when(css.contains("primary") | css.contains("cta"), "PRIMARY")


def plain(html: Column) -> Column:
    """Text without tags, its white space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), SPACES, " ")), F.lit(""))


def with_attributes(rows: DataFrame) -> DataFrame:
    """rows with `names` and `values` (without their quotes) of the attributes in `attrs`, the last first: of a repeated
    attribute the last counts."""
    names = F.reverse(F.regexp_extract_all("attrs", F.lit(ATTRIBUTE), F.lit(1)))
    values = F.reverse(F.regexp_extract_all("attrs", F.lit(ATTRIBUTE), F.lit(2)))
    bare = lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.greatest(F.char_length(x) - 2, F.lit(0)))).otherwise(x)
    return rows.withColumn("names", names).withColumn("values", F.transform(values, bare)).drop("attrs")


def has(name: str) -> Column:
    return F.array_contains("names", F.lit(name))


def given(name: str) -> Column:
    """Value of an attribute without its quotes, '' if it has none; null if the attribute is absent."""
    return F.get("values", F.array_position("names", F.lit(name)).cast("int") - 1)


def attribute(name: str) -> Column:
    """Value of an attribute; null if it is absent or empty."""
    return F.nullif(given(name), F.lit(""))


def validation() -> Column:
    """The rules of a field as JSON; null without any. min, max and step are kept as they are written."""
    number = lambda name: F.expr(f"try_cast(`{name}` AS bigint)")
    rules = {k.lower(): F.when(has(k), F.lit(True)) for k in ("required", "disabled", "readonly")}
    rules |= {"minLength": number("minlength"), "maxLength": number("maxlength")}
    rules |= {k: attribute(k) for k in ("min", "max", "pattern", "step")}
    rules["inputType"] = F.when(F.col("tag") == "input", attribute("type"))
    return F.nullif(F.to_json(F.struct(*[c.alias(k) for k, c in rules.items()])), F.lit("{}"))


def handler() -> Column:
    """The function that the first event attribute calls, else its value, `(inline)` if that is long."""
    value = F.when(F.arrays_overlap("names", F.array(*map(F.lit, HANDLERS))), F.coalesce(*[attribute(h) for h in HANDLERS]))
    called = F.nullif(F.regexp_extract(value, r"([a-zA-Z_$][\w$]*)\s*\(", 1), F.lit(""))
    return F.coalesce(called, F.when(F.char_length(value) > 30, "(inline)").otherwise(value))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, tag, names, values, inner (up to the tag's own end, null of an input), ahead (200 characters from
    the tag on), closes (whether a form ends before the next element)."""
    parts = F.split("html", r"(?i)(?=<(?:button|input|textarea|select|form|a)\b[^>]*>)")
    rows = spread(pages.select("page_id", "url", "html")).select("page_id", "url", parts.alias("parts"))

    def described(part: Column, i: Column) -> Column:
        tag, rest = F.lower(F.regexp_extract(part, TAG, 1)), F.regexp_replace(part, "^" + TAG, "")
        end, after = F.concat(F.lit("</"), tag), lambda: F.array_join(F.slice("parts", i + 2, F.size("parts")), "")
        all_of_it = F.concat(rest, after())
        inner = F.when(tag == "input", None).when(F.contains(rest, end), F.split_part(rest, end, F.lit(1))).when(F.contains(all_of_it, end), F.split_part(all_of_it, end, F.lit(1)))
        ahead = F.when(F.char_length(part) >= 200, F.substring(part, 1, 200)).otherwise(F.substring(F.concat(part, after()), 1, 200))
        made = F.struct(i.alias("pos"), tag.alias("tag"), F.regexp_extract(part, TAG, 2).alias("attrs"), inner.alias("inner"), ahead.alias("ahead"), F.contains(rest, F.lit("</form")).alias("closes"))
        return F.when(part.rlike("^" + TAG), made)

    rows = rows.select("page_id", "url", F.explode(F.filter(F.transform("parts", described), lambda x: x.isNotNull())).alias("e"))
    return with_attributes(rows.select("page_id", "url", "e.*"))


def elements(pages: DataFrame, org: str = "org", template: bool = False) -> DataFrame:
    """Each interactive element of pages (page_id, url, html), in order: page_id, tag, tag_index, href, type_attr, label,
    semantic_role, destructive, required, validation, form_context, handler, tags, endpoint, element_id.

    The label is aria-label, title, placeholder, the value of an input or button, the text up to the tag's own end, or what
    comes next. form_context names the innermost open form, the element itself if it is one. template: the pages are templates,
    which know more words, and whose elements may name their role (data-role)."""
    page, rows = Window.partitionBy("page_id").orderBy("pos"), parsed(pages)
    text = F.coalesce(F.substring(plain(F.col("inner")), 1, 200), F.substring(plain(F.col("ahead")), 1, 80))
    label = F.coalesce(attribute("aria-label"), attribute("title"), attribute("placeholder"), F.when(F.col("tag").isin("input", "button"), attribute("value")), text)
    own = F.coalesce(F.substring(plain(F.col("inner")), 1, 200), attribute("aria-label"), attribute("title"), attribute("placeholder"), attribute("value"))
    closed = F.min(F.when(F.col("closes"), F.col("pos"))).over(page.rowsBetween(0, Window.unboundedFollowing))
    form = F.when(F.col("tag") == "form", F.struct(F.coalesce(closed, F.lit(2**31 - 1)).alias("till"), F.coalesce(given("id"), given("name"), F.lit("(unnamed-form)")).alias("name")))
    rows = rows.withColumn("form", form).withColumn("form", F.last("form", True).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    index = F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("pos")) - F.lit(1)
    rows = rows.withColumn("tag_index", index).withColumn("label", label).withColumns({k: attribute(k) for k in ("minlength", "maxlength")})
    css = F.lower(F.coalesce(attribute("class"), attribute("className"), F.lit("")))
    tags = F.array_compact(F.array(
        F.when((F.col("tag") == "button") & css.contains("icon") & own.isNull(), "icon-only"), F.when(has("disabled"), "disabled"),
        F.when(css.contains("hidden") | (F.coalesce(given("aria-hidden"), F.lit("")) == "true"), "hidden"),
    ))
    role = semantic_role(F.col("tag"), attribute("type"), attribute("href"), F.col("label"), attribute("class"), attribute("data-role") if template else None)
    descriptor = F.concat(F.col("tag"), F.lit("["), F.col("tag_index"), F.lit("]"))
    rows, role = rows.withColumn("semantic_role", role), F.col("semantic_role")  # made once, used twice
    return rows.select(
        "page_id", "tag", "tag_index", attribute("href").alias("href"), attribute("type").alias("type_attr"), "label", role,
        F.coalesce(role.isin(*DESTRUCTIVE), F.lit(False)).alias("destructive"), has("required").alias("required"), validation().alias("validation"),
        F.when(F.col("form.till") >= F.col("pos"), F.col("form.name")).alias("form_context"), handler().alias("handler"), tags.alias("tags"),
        F.when(F.col("tag") == "form", attribute("action")).alias("endpoint"), element_id(F.lit(org), F.col("url"), descriptor).alias("element_id"),
    )


def custom_elements(pages: DataFrame) -> DataFrame:
    """page_id, descriptor, tag, label, handler, route_target, tags of other elements with reactive attributes, in order."""
    at = lambda i: F.regexp_extract_all("html", F.lit(REACTIVE), F.lit(i))
    rows = spread(pages.select("page_id", "html")).select("page_id", F.posexplode(F.arrays_zip(at(1).alias("tag"), at(2).alias("attrs"))).alias("pos", "e")).select("page_id", "pos", F.lower("e.tag").alias("tag"), "e.attrs")
    rows = with_attributes(rows.where(~F.col("tag").isin(*INTERACTIVE)))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - F.lit(1)
    htmx = F.coalesce(attribute("hx-get"), attribute("hx-post"))
    other = F.coalesce(*[attribute(k) for k in ("x-on:click", "v-on:click", "@click")])
    tags = F.array_compact(F.array(F.when(htmx.isNotNull(), "htmx"), F.when(other.isNotNull(), "alpine-or-vue")))
    return rows.select("page_id", F.concat("tag", F.lit("[custom-"), number, F.lit("]")).alias("descriptor"), "tag", F.coalesce(given("title"), given("aria-label")).alias("label"), handler().alias("handler"), F.coalesce(given("href"), given("hx-get"), given("hx-post")).alias("route_target"), tags.alias("tags"))


def spa_shell(html: Column) -> Column:
    """Whether a page is the shell of an application: a mount point or a module script and fewer than four elements."""
    return (F.regexp_count(html, F.lit(r"(?i)<(?:button|input|textarea|select|form|a)\b")) < 4) & (html.rlike(MOUNT) | html.rlike(MODULE))


def metadata(pages: DataFrame) -> DataFrame:
    """page_id, title, description, sections, spa_shell. The title is that of the page, its first h1, og:title or a name in
    structured data; the description the page's own, og:description or one in structured data; sections are up to twelve h2
    and h3."""
    first = lambda tag: F.substring(plain(F.nullif(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))), 1, 200)
    meta = lambda key, name: F.nullif(F.regexp_extract("html", rf"""(?i)<meta[^>]+{key}=["']{name}["'][^>]+content=["']([^"']+)["']""", 1), F.lit(""))
    blocks = F.regexp_extract_all("html", F.lit(r"""(?i)<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>"""), F.lit(1))
    stated = lambda key: F.get(F.filter(F.transform(blocks, lambda b: F.coalesce(F.get_json_object(b, f"$.{key}"), F.get_json_object(b, f"$[0].{key}"))), lambda x: x.isNotNull()), 0)
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<h(?:2|3)[^>]*>([\s\S]*?)</h(?:2|3)>"), F.lit(1)), lambda h: F.substring(plain(h), 1, 120))
    title = F.coalesce(first("title"), first("h1"), F.substring(meta("property", "og:title"), 1, 200), F.substring(stated("name"), 1, 200))
    about = F.coalesce(meta("name", "description"), meta("property", "og:description"), stated("description"))
    return pages.select("page_id", title.alias("title"), F.substring(about, 1, 500).alias("description"), F.slice(F.filter(heads, lambda h: h.isNotNull()), 1, 12).alias("sections"), spa_shell(F.col("html")).alias("spa_shell"))


def crawl_mode(pages: DataFrame) -> DataFrame:
    """page_id, elements, mode: `headless` where a page shows fewer than three elements or is a shell, else `http`."""
    n = F.regexp_count("html", F.lit(TAG))
    return pages.select("page_id", n.alias("elements"), F.when((n < 3) | spa_shell(F.col("html")), "headless").otherwise("http").alias("mode"))
