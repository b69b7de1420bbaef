"""Content typing and codec choice as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of content.
TEXT, BINARY, COMPRESSED, UNKNOWN = "text", "binary", "compressed", "unknown"
MARKUP = "markup"
BLOCK_SORTED = ("bmp", "dna", "pnm", "mp4", "flac", "avi", "dicom", "media")
INCOMPRESSIBLE = ("packjpg", "audio_compressed")
#: From below which level a codec refuses compressed content, and the subtypes that it takes all the same
#: ("*": all but those named in the third place).
SKIP_RULES = {
    "zlib": (7, ("lzw", "lz", "lzo"), ()),
    "bzip2": (7, ("lzw", "gz", "lz", "lzo"), ()),
    "lzfx": (7, (), ()),
    "ppmd": (99, (), ()),
    "libbsc": (7, ("*",), ("bz2", "lzma")),
    "lzma": (99, ("*",), ("zpaq",)),
}
#: Extensions that are known without a table of the user's own: primary kinds, subtype.
EXTENSIONS = {
    **dict.fromkeys("c h cc cpp hpp txt py js sh java go rs sql csv json md conf cfg".split(), (TEXT, "")),
    **dict.fromkeys("html htm xml".split(), (TEXT, MARKUP)),
    **dict.fromkeys("o so a bin dat".split(), (BINARY, "")),
    "gz": (COMPRESSED, "gz"), "bz2": (COMPRESSED, "bz2"), "xz": (COMPRESSED, "lzma"), "zip": (COMPRESSED, "zip"), "lz": (COMPRESSED, "lz"),
    "lzo": (COMPRESSED, "lzo"), "rar": (COMPRESSED, "rar"), "zpaq": (COMPRESSED, "zpaq"), "z": (COMPRESSED, "lzw"),
    "jpg": (BINARY, "jpeg"), "jpeg": (BINARY, "jpeg"), "bmp": (BINARY, "bmp"), "pdf": (BINARY, "pdf"), "tar": (BINARY, "tar"), "wav": (BINARY, "wav"),
    "flac": (BINARY, "flac"), "avi": (BINARY, "avi"), "mp4": (BINARY, "mp4"), "dcm": (BINARY, "dicom"), "pnm": (BINARY, "pnm"), "exe": (BINARY, "exe32"),
    "mp3": (COMPRESSED, "audio_compressed"), "pjg": (COMPRESSED, "packjpg"),
}


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def byte_classes(text: Column) -> dict[str, Column]:
    """Counts over the UTF-8 bytes of a text; tags are "</" and "/>" once spaces are left out."""
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return {
        "n_bytes": F.octet_length(text).cast("long"),
        "hi": (F.octet_length(text) - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))).cast("long"),
        "ctl": (F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x1F]", ""))).cast("long"),
        "spaces": occurrences(text, " "), "lt": occurrences(text, "<"), "gt": occurrences(text, ">"),
        "tags": occurrences(tight, "</") + occurrences(tight, "/>"),
    }


def verdicts() -> dict[str, Column]:
    """ten, thirty and fifty percent verdicts and markup, over the columns of byte_classes()."""
    n, hi, ctl, lt, gt = (F.col(c) for c in ("n_bytes", "hi", "ctl", "lt", "gt"))
    eighths = F.shiftright(n, 1) + F.shiftright(n, 2) + F.shiftright(n, 3)
    return {
        "ten": F.when((10 * hi <= n) & (ctl < eighths), TEXT).otherwise(BINARY),
        "thirty": F.when(10 * (hi + ctl) > 3 * n, BINARY).otherwise(TEXT),
        "fifty": F.when(10 * (hi + ctl) > 5 * n, BINARY).otherwise(TEXT),
        # the counts are unsigned: with fewer than four ">" the lower bound wraps and nothing is markup
        "markup": (gt >= 4) & (lt > gt - 4) & (lt < gt + 4) & (10 * F.col("tags") > 4 * lt) & (100 * (lt + gt) > 6 * F.col("spaces")),
    }


def simple_text() -> Column:
    n = F.col("n_bytes")
    return F.when((10 * F.col("hi") <= n) & (F.col("ctl") < F.shiftright(n, 1) + F.shiftright(n, 2) + F.shiftright(n, 3)), TEXT).otherwise(UNKNOWN)


def block_sort_preferred(primary: Column, subtype: Column) -> Column:
    return subtype.isin(*BLOCK_SORTED) | ((primary == TEXT) & (subtype != MARKUP)) | ((primary == BINARY) & (subtype == MARKUP))


def adaptive_codec(mode: str, primary: Column, subtype: Column, block_sorter: bool = True) -> Column:
    """The codec that adapt or adapt2 gives to content of a kind; subtype is "" if there is none.

    Unknown, text, tar and PDF content has been typed anew before, by the 50 % (adapt) or 30 % (adapt2) verdict.
    """
    sorts = block_sort_preferred(primary, subtype)
    out = F.when(subtype.isin(*INCOMPRESSIBLE) & ~sorts, "lz4").when((primary == BINARY) & ~sorts, "lzma" if mode == "adapt2" else "bzip2")
    return out.when(sorts, "libbsc").otherwise("ppmd") if mode == "adapt2" and block_sorter else out.otherwise("ppmd")


def codec_skips(codec: str, level: Column, primary: Column, subtype: Column) -> Column:
    """Whether a codec refuses content that is compressed already."""
    if codec not in SKIP_RULES:
        return F.lit(False)
    below, taken, refused = SKIP_RULES[codec]
    if taken == ("*",):
        return (primary == COMPRESSED) & (level < below) & subtype.isin(*refused)
    return (primary == COMPRESSED) & (level < below) & ~subtype.isin(*taken)


def extension(path: Column) -> Column:
    """What follows the last dot of the last name, or "" without a dot."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def type_by_extension(members: DataFrame, types: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """members (path, ...) with primary and subtype; extensions over eight characters are unknown."""
    types = EXTENSIONS if types is None else types
    rows = members.sparkSession.createDataFrame([(k, *v) for k, v in sorted(types.items())], "ext string, primary string, subtype string")
    out = members.withColumn("ext", F.lower(extension(F.col("path"))))
    out = out.withColumn("ext", F.when(F.length("ext") <= 8, F.col("ext")).otherwise(""))
    out = out.join(F.broadcast(rows), "ext", "left")  # a row for each extension of the parameter
    return out.withColumns({"primary": F.coalesce("primary", F.lit(UNKNOWN)), "subtype": F.coalesce("subtype", F.lit(""))})


def le16(data: Column, at: int) -> Column:
    return F.coalesce(F.conv(F.hex(F.concat(F.substring(data, at + 2, 1), F.substring(data, at + 1, 1))), 16, 10).cast("int"), F.lit(-1))


def type_by_magic(data: Column) -> Column:
    """Primary and subtype, joined by a slash, from the first bytes; the first rule that holds counts."""
    at = lambda i, n: F.hex(F.substring(data, i + 1, n))
    is_ = lambda i, magic: at(i, len(magic)) == magic.hex().upper()
    head = F.substring(data, 1, 127)
    n = F.octet_length(data)
    rules = (
        (n < 10, UNKNOWN),
        (is_(0, b"RIFF") & is_(8, b"WAVE"), "binary/wav"),
        (is_(0, b"!<arch>\n"), "binary/ar"),
        (is_(257, b"ustar\0") | is_(257, b"ustar  \0"), "binary/tar"),
        (is_(0, b"%PDF-"), "binary/pdf"),
        ((n > 127) & (F.hex(head).rlike("^(..)*4449434D") | F.hex(head).rlike("^(..)*49534F5F495220")), "binary/dicom"),
        (is_(0, b"\xff\xd8") & (is_(6, b"Exif") | is_(6, b"JFIF")), "binary/jpeg"),
        (is_(0, b"\x7fELF") & is_(16, b"\x04"), BINARY),
        (is_(0, b"\x7fELF") & is_(4, b"\x02"), "binary/exe64"),
        (is_(0, b"\x7fELF"), "binary/exe32"),
        (is_(0, b"MZ") | is_(0, b"LZ"), "binary/exe32"),
        (is_(0, b"BM") & le16(data, 14).isin(12, 40, 64, 128), "binary/bmp"),
        (is_(0, b"TZif"), BINARY),
        (is_(0, b"wvpk") | is_(0, b"TTA1"), "compressed/audio_compressed"),
        (at(0, 2).rlike("^50(3[1-7])$"), "binary/pnm"),
        ((is_(0, b"\xe9") | is_(0, b"\xeb")) & (le16(data, 0x1FE) == 0xAA55), "binary/exe32"),
        (is_(0, b"\xe9") | is_(0, b"\xeb"), BINARY),
        (le16(data, 0) == 0x8664, "binary/exe64"),
        (is_(0, b"\x55\xaa"), "binary/exe32"),
    )
    out = F.lit(UNKNOWN)
    for test, kind in reversed(rules):
        out = F.when(test, kind).otherwise(out)
    return out
