"""Scalar text functions as Spark columns: normalising, tokens, URLs, masking, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain and path marks of the source tiers, in the order in which they are tried.
S_DOMAINS = (".gov.cn", ".gov", ".edu.cn", ".edu")
S_PATHS = ("/investor", "/ir", "/announcement", "/about")
S_EXCLUDED = ("zhihu.com", "zhidao", "tieba", "douban")
A_DOMAINS = ("tianyancha.com", "qichacha.com", "gsxt.gov.cn", "sec.gov", "sec.report", "bloomberg.com")
A_TITLES = ("investor relations", "annual report", "about us", "公司简介", "关于我们", "投资者关系")
B_DOMAINS = ("wikipedia.org", "baike.baidu.com", "36kr.com", "crunchbase.com", "linkedin.com", "sina.com", "qq.com", "163.com", "sohu.com", "thepaper.cn", "ft.com", "wsj.com", "reuters.com")
D_DOMAINS = ("zhihu.com", "zhidao.baidu.com", "tieba.baidu.com", "douban.com", "xiaohongshu.com", "weibo.com", "blog.", "forum.", "bbs.")

# Separators of phrases.
PHRASE_SEPARATORS = r"[，。、；：！？\s\n()（）\[\]【】\"/,!?;:\\-]+"
FULL_WIDTH = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def any_contains(text: Column, words) -> Column:
    """Whether any of the (fixed) words occurs in the text."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def count_contains(text: Column, words) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def mentions(text: Column, aliases: Column) -> Column:
    """Whether any alias of an array column occurs in the text, whatever the case."""
    low = F.lower(text)
    return F.exists(aliases, lambda a: F.contains(low, F.lower(a)))


def normalise_value(value: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Lower case, half width, single spaces, no brand prefix before more text, plain punctuation."""
    v = F.translate(F.lower(F.trim(value)), FULL_WIDTH, HALF_WIDTH)
    v = F.regexp_replace(v, r"\s+", " ")
    if prefixes:
        v = F.regexp_replace(v, f"^({'|'.join(prefixes)})\\s+(.+)", "$2")
    return F.trim(F.translate(v, "，。、（）：", ",.,():"))


def ngram_tokens(text: Column) -> Column:
    """Phrases of two characters or more, with all their two- and three-character windows."""
    phrases = F.filter(F.transform(F.split(F.lower(text), PHRASE_SEPARATORS), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)

    def grams(p: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2)))
        three = F.when(F.length(p) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substr(p, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(p), two, three)

    return F.array_distinct(F.flatten(F.transform(phrases, grams)))


def space_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w一-鿿]+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of ``a``; 0 for an empty ``a``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[。\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s)\]】]+"), F.lit(0))


def first_list_item(text: Column) -> Column:
    """The text of the first numbered or dashed list item; null without one."""
    item = r"(?:^|\n)\s*(?:[0-9]+[.)、]|[-*])\s*([^\n]{0,80})"
    return F.when(text.rlike(item), F.regexp_extract(text, item, 1))


def unresolved(text: Column) -> Column:
    """Template variables left in a text."""
    return F.regexp_extract_all(text, F.lit(r"\{[^{}]+\}"), F.lit(0))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Variables replaced by scalars, or by arrays joined with an ideographic comma; empty values leave the variable."""
    for name, value in values.items():
        mark = "{" + name + "}"
        template = F.when(F.coalesce(value, F.lit("")) != "", F.replace(template, F.lit(mark), value)).otherwise(template)
    return template


def four_digits(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b([0-9]{4})\b", 1), F.lit("")).cast("int")


def first_number(text: Column) -> Column:
    """The first number, its thousands separators dropped."""
    return F.nullif(F.replace(F.regexp_extract(text, r"[0-9][0-9,]*", 0), F.lit(","), F.lit("")), F.lit("")).try_cast("long")


def domain(value: Column) -> Column:
    """Host without scheme; a leading run of w and dots goes, even where it belongs to the name."""
    v = F.regexp_replace(F.lower(F.trim(value)), "https?://", "")
    return F.split(F.regexp_replace(F.regexp_replace(v, "^[w.]+", ""), "/+$", ""), "/").getItem(0)


def source_tier(url: Column, title: Column | None = None) -> Column:
    """S, A, B, C or D by domain, path and title; C for an empty URL."""
    low = F.lower(url)
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.when(host == "", F.split(low, "[/?#]").getItem(0)).otherwise(host)
    allowed = ~any_contains(host, S_EXCLUDED)
    ladder = F.when(F.coalesce(url, F.lit("")) == "", "C").when(any_contains(host, S_DOMAINS), "S").when(any_contains(low, S_PATHS) & allowed, "S").when(any_contains(host, A_DOMAINS), "A")
    if title is not None:
        ladder = ladder.when(any_contains(F.lower(F.coalesce(title, F.lit(""))), A_TITLES) & allowed, "A")
    return ladder.when(any_contains(host, B_DOMAINS), "B").when(any_contains(host, D_DOMAINS), "D").otherwise("C")


def digest(*columns: Column, length: int = 64) -> Column:
    """First hexadecimal digits of the SHA-256 of the columns joined by a bar."""
    return F.left(F.sha2(F.concat_ws("|", *columns), 256), F.lit(length))


def sanitise_html(html: Column) -> Column:
    """Without script, style, iframe and object blocks, event handlers and javascript: links."""
    out = F.regexp_replace(html, r"(?is)<(script|style|iframe|object|embed)[^>]*>.*?</(script|style|iframe|object|embed)>", "")
    out = F.regexp_replace(out, r"(?i)\son[a-z]+=(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(out, "(?i)javascript:", "")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(sanitise_html(html), "(?s)<[^>]*>", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mask(text: Column, limit: int = 500) -> Column:
    """E-mail addresses, keys and file paths replaced by marks; at most ``limit`` characters."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{16,}", "[key]")
    out = F.regexp_replace(out, r"[A-Za-z0-9+/]{40,}={0,2}", "[token]")
    out = F.regexp_replace(out, r"/(home|root|usr|etc|var|tmp)(/[A-Za-z0-9._-]+)+", "[path]")
    return F.left(out, F.lit(limit))


def mask_credential(value: Column) -> Column:
    """First and last four characters of a longer value."""
    return F.when(F.length(value) <= 8, "****").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****"), F.right(value, F.lit(4))))


def week_bucket(ts: Column) -> Column:
    """Calendar year with ISO week: the last days of a year can bear its name with week 01."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def ladder(x: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The label of the first step that ``x`` reaches."""
    out = None
    for least, label in steps:
        out = F.when(x >= least, label) if out is None else out.when(x >= least, label)
    return F.lit(default) if out is None else out.otherwise(default)


# Words of an error text and the code they stand for, in the order in which they are tried.
ERROR_CODES = (("timeout", "timeout"), ("timed out", "timeout"), ("429", "rate_limited"), ("rate limit", "rate_limited"), ("401", "auth_failed"), ("unauthorized", "auth_failed"), ("quota", "quota_exhausted"), ("empty", "empty_response"), ("connection", "network_error"))


def error_code(text: Column, codes=ERROR_CODES) -> Column:
    low, out = F.lower(text), None
    for word, code in codes:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("unknown_error")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|\s]+', "_")


def percent_bar(ratio: Column, width: int = 10) -> Column:
    full = F.floor(ratio * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), width - full), F.format_string(" %d%%", F.round(ratio * 100).cast("int")))


def safe_url(url: Column) -> Column:
    """HTTPS to a named public host: no credentials, no addresses, no local names."""
    host = F.regexp_extract(F.lower(url), r"^https://([^/?#:@]+)(?=[:/?#]|$)", 1)
    return (host != "") & ~host.rlike(r"^[0-9.]+$|^localhost$|\.local$|\.internal$") & host.contains(".")


def markdown_html(text: Column) -> Column:
    """Headings, bold text and list items of Markdown as HTML."""
    out = F.regexp_replace(text, r"(?m)^### (.*)$", "<h3>$1</h3>")
    out = F.regexp_replace(out, r"(?m)^## (.*)$", "<h2>$1</h2>")
    out = F.regexp_replace(out, r"(?m)^# (.*)$", "<h1>$1</h1>")
    out = F.regexp_replace(out, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(out, r"(?m)^[-*] (.*)$", "<li>$1</li>")


def hmac_sha256(message: Column, key: Column) -> Column:
    """HMAC-SHA256 in lower-case hex: key and message as bytes (texts as UTF-8), block of 64 bytes, no Python.

    Null if either is null."""
    message, key = message.cast("binary"), key.cast("binary")
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    block = F.rpad(F.hex(short), 128, "0")
    number = lambda i: F.conv(F.substring(block, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def padded(pad: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(number(i).bitwiseXOR(F.lit(pad))), 2, "0"))
        return F.unhex(F.array_join(each, ""))

    inner = F.unhex(F.sha2(F.concat(padded(0x36), message), 256))
    return F.when(key.isNotNull() & message.isNotNull(), F.sha2(F.concat(padded(0x5C), inner), 256))


def webhook_signature(payload: Column, secret: Column, timestamp: Column) -> Column:
    """Signature of a delivery: payload and time stamp under the target's secret."""
    return F.concat(F.lit("sha256="), hmac_sha256(F.concat(payload.cast("binary"), timestamp.cast("string").cast("binary")), secret))
