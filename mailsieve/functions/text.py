"""Column expressions over text, addresses and URLs; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx


#: What any folding below can change: soft hyphens, and all from Greek upwards but common punctuation.
FOLDABLE = r"[\x{AD}\x{370}-\x{200F}\x{202A}-\x{10FFFF}]"
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _plain(c: Column) -> Column:
    """Whether no folding can change a text: cheap tests that spare most texts the dear ones."""
    return (F.octet_length(c) == F.char_length(c)) | ~F.rlike(c, F.lit(FOLDABLE))


def _fold(c: Column, lookalikes: bool) -> Column:
    return F.translate(c, lx.FULL_WIDTH + (lx.LOOKALIKES_FROM if lookalikes else ""), lx.HALF_WIDTH + (lx.LOOKALIKES_TO if lookalikes else ""))


def normalise(c: Column, screener: bool = False) -> Column:
    """Format characters deleted, full width folded, lower case; the screener's form also folds look-alikes."""
    gone = F.regexp_replace(c, f"[{lx.ZERO_WIDTH}{lx.TAGS if screener else ''}]", "")
    return F.lower(F.when(_plain(c), c).otherwise(_fold(gone, screener)))


def normalise_spaced(c: Column, screener: bool = False) -> Column:
    """The same with format characters as spaces, and white space collapsed."""
    spaced = _fold(F.regexp_replace(c, f"[{lx.ZERO_WIDTH}{lx.TAGS if screener else ''}]", " "), screener)
    return F.lower(F.trim(F.regexp_replace(F.when(_plain(c), c).otherwise(spaced), SPACES, " ")))


def both_forms(c: Column, screener: bool = False) -> list[Column]:
    return [normalise(c, screener), normalise_spaced(c, screener)]


def array_of(values: list) -> Column:
    """A literal array of texts or whole numbers, parsed at once: a call for every element takes longer than many queries."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(int(v))
    return F.expr(f"array({', '.join(map(quoted, values))})")


def _forms(forms: Column | list[Column]) -> Column:
    return F.array(*forms) if isinstance(forms, list) else F.array(forms)


def has(forms: Column | list[Column], term: str) -> Column:
    return F.exists(_forms(forms), lambda f: F.contains(f, F.lit(term)))


def any_of(forms: Column | list[Column], terms: list[str]) -> Column:
    """Whether a term occurs in a form. Terms are one literal array, and every form stands in the expression once:
    an OR over all of them would repeat the forms for every term, and outgrow the JVM's limit of generated code."""
    return F.exists(_forms(forms), lambda f: F.exists(array_of(terms), lambda t: F.contains(f, t)))


def _found(forms: Column | list[Column], terms: list[str], result) -> Column:
    hit = lambda fs: F.filter(array_of(list(dict.fromkeys(terms))), lambda t: F.exists(fs, lambda f: F.contains(f, t)))
    return F.get(F.transform(F.array(_forms(forms)), lambda fs: result(fs, hit(fs))), F.lit(0))  # the outer array binds the forms


def count_of(forms: Column | list[Column], terms: list[str]) -> Column:
    """Number of distinct terms that occur; null for a null text."""
    return _found(forms, terms, lambda fs, found: F.when(F.get(fs, F.lit(0)).isNotNull(), F.size(found)))


def hits_of(forms: Column | list[Column], terms: list[str]) -> Column:
    """Terms that occur, as an array in list order."""
    return _found(forms, terms, lambda fs, found: found)


def fold_digits(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"[\x{FF10}-\x{FF19}]")), F.translate(c, "".join(chr(0xFF10 + d) for d in range(10)), "0123456789")).otherwise(c)


def url_host(c: Column) -> Column:
    """Lower-case host: scheme, path, query, user part, port and IPv6 brackets dropped."""
    authority = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(host, r"^([^:]*)", 1)))


def pivot_host(c: Column) -> Column:
    """Host as the channel detector takes it: cut at the first of / ? # and :, the user part stays."""
    return F.regexp_extract(c, r"^(?:.*?://)?([^/?#:]*)", 1)


def host_is(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def query_param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_extract(url, r"^([^#]*)", 1), rf"[?&]{name}=([^&]*)", 1), F.lit(""))


def address_domain(c: Column) -> Column:
    """What follows the last @, up to a closing angle bracket; null if nothing does."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(c, r"@([^@>]*)>?\s*$", 1))), F.lit(""))


def display_name(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(c, r"^([^<]*)<", 1)), '^"|"$', "")), F.lit(""))


def strip_reply(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^\s*(?:(?:re|fw|fwd)\s*:\s*)+", "")


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-case words longer than one byte; two empty sets are alike."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.octet_length(w) > 1))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def one_edit_apart(a: Column, b: Column) -> Column:
    """Exactly one substitution or one insertion apart; equal strings are not."""
    return F.levenshtein(a, b, 1) == 1


def within_edits(a: Column, b: Column, k: int) -> Column:
    d = F.levenshtein(a, b, k)
    return (d > 0) & (d <= k)


def decode_base64_tokens(c: Column) -> Column:
    """UTF-8 texts of the base64 tokens of 20 characters or more."""
    tokens = F.filter(F.split(c, r"[^A-Za-z0-9+/=]+"), lambda t: F.length(t) >= 20)
    bare = F.transform(tokens, lambda t: F.rtrim(t, F.lit("=")))
    whole = F.transform(bare, lambda t: F.try_to_binary(F.rpad(F.when(F.length(t) % 4 == 1, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t), F.when(F.length(t) % 4 == 1, F.length(t) - 1).otherwise((F.ceil(F.length(t) / 4) * 4).cast("int")), F.lit("=")), F.lit("base64")))
    return F.transform(F.filter(whole, lambda b: b.isNotNull() & F.is_valid_utf8(F.decode(b, "ISO-8859-1").cast("string")) & F.is_valid_utf8(b.cast("string"))), lambda b: F.decode(b, "UTF-8"))


def decode_entities(c: Column) -> Column:
    """HTML entities decoded once: decimal, hexadecimal and six names."""
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)"), 1))
    hex_ = lambda e: F.conv(F.regexp_extract(e, r"&#[xX]([0-9A-Fa-f]+);", 1), 16, 10).cast("int")
    code = lambda e: F.coalesce(F.nullif(F.regexp_extract(e, r"&#([0-9]+);", 1), F.lit("")).cast("int"), hex_(e))
    char = lambda e: F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")
    named = c
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        named = F.replace(named, F.lit(f"&{name};"), F.lit(ch))
    done = F.aggregate(numbers, named, lambda s, e: F.replace(s, e, F.when(code(e) < 0x110000, char(e)).otherwise(e)))
    return F.replace(done, F.lit("&amp;"), F.lit("&"))


def _percent_once(c: Column) -> Column:
    good = lambda p: F.rlike(p, F.lit("^[2-9A-Fa-f][0-9A-Fa-f]"))  # noqa: E731  bytes under 0x20 stay encoded
    byte = lambda p: F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1")
    parts = F.split(c, "%")
    rest = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(rest, lambda p: F.when(good(p), F.concat(byte(p), F.substr(p, F.lit(3)))).otherwise(F.concat(F.lit("%"), p))), ""))


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded three times over, a byte becoming one Latin-1 character."""
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    return F.when(F.contains(c, F.lit("%")), bound(bound(_percent_once(c), _percent_once), _percent_once)).otherwise(c)


def url_decoded(c: Column) -> Column:
    """Percent escapes of a URL's part decoded as UTF-8; a plus sign and a stray % stay. Null where bytes are no UTF-8."""
    return F.try_url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def tag_payload(c: Column) -> Column:
    """ASCII hidden in Unicode tag characters; null if there is none."""
    tags = F.array_join(F.regexp_extract_all(c, F.lit(r"([\x{E0020}-\x{E007E}])"), 1), "")
    return F.nullif(F.translate(tags, "".join(chr(0xE0000 + n) for n in range(0x20, 0x7F)), "".join(map(chr, range(0x20, 0x7F)))), F.lit(""))


EMOJI = r"\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{2B50}-\x{2B55}\x{FE00}-\x{FE0F}"


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, f"[{EMOJI}]", "")


def collapse_letters(c: Column) -> Column:
    """Letter-spaced lower-case words closed up: a space goes when it stands between single letters."""
    return F.regexp_replace(c, r"(?<=(?:^|[^a-z])[a-z]) (?=[a-z](?: |[^A-Za-z]|$))|(?<=[a-z] [a-z]) (?=[a-z](?: |[^A-Za-z]|$))", "")
