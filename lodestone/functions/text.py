"""Text functions as Column expressions: normal forms, words, names and scores. All stay inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search. Fixed values.
STOPWORDS = ["the", "a", "an", "and", "with", "from", "that", "this", "play", "song", "remix", "story", "records"]
# What a compilation's artist contains. Fixed values.
COMPILATION_KEYWORDS = ["various", "soundtrack", "compilation", "v/a", "v.a."]
# What the address of an image that stands for none contains. A fixed value.
PLACEHOLDER = "spacer.gif"
# What a bracket with a version's name looks like, in lower case. A fixed value.
VERSION = r"\((.*?(?:remix|mix|version|edit).*?)\)"


#: White space of all scripts, and the four separators that count as such.
SPACE = r"[\s\x1c-\x1f]"


def _marks() -> str:
    """A regular expression's class of all combining characters, by groups, so that most characters are told by few comparisons."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    runs = [list(g) for _, g in groupby(codes, lambda c, n=iter(range(len(codes))): c - next(n))]
    span = lambda a, b: f"\\x{{{a:x}}}-\\x{{{b:x}}}"
    groups = [runs[i : i + 16] for i in range(0, len(runs), 16)]
    return f"[{span(codes[0], codes[-1])}&&[" + "".join(f"[{span(g[0][0], g[-1][-1])}&&[{''.join(span(r[0], r[-1]) for r in g)}]]" for g in groups) + "]]"


_MARKS = _marks()


def strip_diacritics(x: Column) -> Column:
    """Without combining marks after compatibility decomposition, of all scripts; letters that have none, as ø, stay. ASCII texts stay as they are."""
    decomposed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), x, F.lit(True))
    return F.when(x.rlike(r"[^\x00-\x7f]"), F.regexp_replace(decomposed, _MARKS, "")).otherwise(x)


def norm(x: Column) -> Column:
    """Lower case without diacritics; null is empty. White space stays."""
    return F.coalesce(F.lower(strip_diacritics(x)), F.lit(""))


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, f"(?U){SPACE}+", " "), r"^ | $", "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"(?U)^{SPACE}+|{SPACE}+$", "")


def words(x: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(x, f"(?U){SPACE}+"), lambda w: w != "")


def plain_words(x: Column) -> Column:
    """Words of a normal form, ASCII letters and digits alone."""
    return words(F.regexp_replace(norm(x), r"[^a-z0-9\s]", " "))


def marked_words(x: Column) -> Column:
    """Words in lower case with punctuation as space, letters of all scripts kept."""
    return words(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "))


def significant(found: Column, longer_than: int) -> Column:
    return F.filter(found, lambda w: (F.length(w) > longer_than) & ~w.isin(STOPWORDS))


def tokens(x: Column) -> Column:
    """Full-text tokens: runs of letters and digits of a normal form."""
    return F.filter(F.split(norm(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_compilation(x: Column) -> Column:
    low = F.lower(x)
    found = F.lit(False)
    for word in COMPILATION_KEYWORDS:
        found = found | low.contains(word)
    return F.coalesce(found, F.lit(False))


def confidence(asked_artist: Column, asked_album: Column, artist: Column, album: Column) -> Column:
    """0.4 for each part that is equal, 0.3 for one within the other, 0.2 more from 0.6 on; 0.2 at least, 1 at most."""

    def part(a: Column, b: Column) -> Column:
        a, b = strip(F.lower(F.coalesce(a, F.lit("")))), strip(F.lower(F.coalesce(b, F.lit(""))))
        both = (a != "") & (b != "")
        return F.when(both & (a == b), 4).when(both & (a.contains(b) | b.contains(a)), 3).otherwise(0)

    tenths = part(asked_artist, artist) + part(asked_album, album)
    raised = F.when(tenths >= 6, tenths + 2).when(tenths == 0, 2).otherwise(tenths)
    return F.least(raised, F.lit(10)) / F.lit(10.0)


# Two parts about a dash with white space on one side at least. A fixed value.
DASHED = r"(.+?)\s*-\s+(.+)|(.+?)\s+-\s*(.+)"


def ambiguous_parts(x: Column) -> Column:
    """(part1, part2) of "X - Y" or else of "X. Y", trimmed; null where either is empty or there is no separator."""
    # most texts have no dash and are not searched
    group = lambda i: F.when(x.contains("-"), F.regexp_extract(x, f"(?dU){DASHED}", i)).otherwise(F.lit(""))
    by_dash = (group(1) != "") & (group(2) != "")
    first, second = (strip(F.when(by_dash, group(i)).otherwise(group(i + 2))) for i in (1, 2))
    at = F.instr(x, ". ")
    one, two = strip(F.substring(x, F.lit(1), at - 1)), strip(F.substring(x, at + 2, F.length(x)))
    pair = lambda a, b: F.struct(a.alias("part1"), b.alias("part2"))
    return F.when((first != "") & (second != ""), pair(first, second)).when((at > 0) & (one != "") & (two != ""), pair(one, two))


def artist_and_album(x: Column) -> Column:
    """"Artist - Album" at the first separator, trimmed; without one all is the album."""
    at = F.instr(x, " - ")
    return F.struct(
        F.when(at > 0, strip(F.substring(x, F.lit(1), at - 1))).otherwise("").alias("artist"),
        F.when(at > 0, strip(F.substring(x, at + 3, F.length(x)))).otherwise(x).alias("album"),
    )


def without_suffix(x: Column) -> Column:
    """Lower case, cut at the first bracket."""
    return strip(F.substring_index(F.lower(x), "(", 1))


def call_number(genre: Column, form: Column, letters: Column, artist_number: Column, release_number: Column) -> Column:
    """Parts that are there, with spaces between and the release's number after a slash; null if that number stands alone."""
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    head = F.concat_ws(" ", text(genre), text(form), text(letters), text(artist_number))
    return F.when(release_number.isNull(), head).when(head != "", F.concat(head, F.lit("/"), release_number.cast("string")))


def version_in(raw: Column) -> Column:
    """What a bracket with remix, mix, version or edit holds, in lower case; empty without one."""
    return F.regexp_extract(F.lower(raw), VERSION, 1)


def song_with_version(song: Column, raw: Column) -> Column:
    """The song with the version that the message names in brackets, if the message has the song."""
    named = (version_in(raw) != "") & F.lower(raw).contains(F.lower(song))
    return F.when(named, F.concat(song, F.lit(" ("), version_in(raw), F.lit(")"))).otherwise(song)


def keyword_query(artist: Column, song: Column) -> Column:
    """Two telling words of the artist and two of the song; empty without any."""
    two = lambda x: F.slice(significant(marked_words(x), 3), 1, 2)
    return F.array_join(F.concat(two(artist), two(song)), " ")


def url_of(base: str, id_: Column) -> Column:
    """The address of a row or release under an address that ends where its number goes."""
    return F.concat(F.lit(base), id_.cast("string"))


def image_or_null(url: Column) -> Column:
    """Null for an empty image address or a placeholder's."""
    return F.when((url != "") & ~url.contains(PLACEHOLDER), url)


def cache_key(function: str, **arguments: Column) -> Column:
    """A digest of a function's name and arguments, whatever their order."""
    named = [arguments[k].alias(k) for k in sorted(arguments)]
    return F.md5(F.concat(F.lit(function), F.lit(":"), F.to_json(F.struct(*named), {"ignoreNullFields": "false"})))
