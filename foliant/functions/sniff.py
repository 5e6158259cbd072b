"""First-match rules over names, sizes and leading bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind, leading bytes, name marks of maps.
DOCUMENTS = (".pdf", ".docx", ".epub", ".txt", ".md", ".csv", ".rtf", ".odt", ".xlsx", ".pptx")
ARCHIVES = (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2")
IMAGES = {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".gif": "gif", ".webp": "webp", ".bmp": "bmp", ".tif": "tiff", ".tiff": "tiff"}
PLUGINS = (".esp", ".esm", ".esl")
WEIGHTS = (".safetensors", ".gguf", ".ckpt")
IMAGE_MAGIC = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"))
ARCHIVE_MAGIC = (("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("7z", "377ABCAF271C"), ("rar", "526172211A07"), ("gzip", "1F8B"))
MAP_MARKS = ("battlemap", "grid-map", "dungeon-map")
SENDABLE = ("jpeg", "png", "webp")
BINS = ("_Maps", "_GameMods", "_Installers", "_Documents", "_ModelWeights", "_Images", "_Archives", "_Unknown")
RATING = {"high": 5, "low": 2, "unsure": 0}


def begins(header: Column, digits: str) -> Column:
    return F.coalesce(F.hex(header).startswith(digits), F.lit(False))


def first_of(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first case that holds."""
    chain = reduce(lambda acc, case: acc.when(*case), cases[1:], F.when(*cases[0]))
    return chain if otherwise is None else chain.otherwise(otherwise)


def image_magic(header: Column) -> Column:
    webp = begins(header, "52494646") & (F.hex(F.substring(header, 9, 4)) == "57454250")
    return first_of([*[(begins(header, d), F.lit(k)) for k, d in IMAGE_MAGIC], (webp, F.lit("webp"))])


def archive_magic(header: Column) -> Column:
    return first_of([(begins(header, d), F.lit(k)) for k, d in ARCHIVE_MAGIC])


def sendable_image(header: Column, ext: Column, size: Column, most: int) -> Column:
    """struct<ok, reason>: JPEG, PNG and WebP by content, up to a size."""
    kind = F.coalesce(image_magic(header), first_of([(ext == e, F.lit(k)) for e, k in IMAGES.items()]))
    answer = lambda ok, why=None: F.struct(F.lit(ok).alias("ok"), F.lit(why).cast("string").alias("reason"))
    known = F.coalesce(image_magic(header).isin(*SENDABLE), F.lit(False))
    return first_of(
        [(kind.isNull(), answer(False)), (~known, answer(False, "format cannot be sent")), (size > most, answer(False, "too large to send"))],
        answer(True),
    )


def classify(name: Column, ext: Column, size: Column, header: Column, least_weight: int = 50 << 20) -> Column:
    """struct<bin, confidence, rule> of the first rule that holds; the last one always does."""
    ext, lower = F.lower(ext), F.lower(name)
    bare = F.substring(ext, 2, 20)
    hit = lambda where, sure, rule: F.struct(F.lit(where).alias("bin"), F.lit(sure).alias("confidence"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))
    tagged = lambda mark, value: F.concat(F.lit(mark), value)
    picture, packed = image_magic(header), archive_magic(header)
    is_map = reduce(lambda a, b: a | b, [lower.contains(m) for m in MAP_MARKS])
    return first_of(
        [
            (ext.isin(*WEIGHTS), hit("_ModelWeights", "high", tagged("ext-", bare))),
            (ext.isin(".pt", ".bin") & (size >= least_weight), hit("_ModelWeights", "high", "size-large-weight")),
            (ext.isin(".pt", ".bin"), hit("_Unknown", "unsure", "ext-small-weight")),
            (ext.isin(".exe", ".msi") & begins(header, "4D5A"), hit("_Installers", "high", "magic-mz")),
            ((ext == ".msi") & begins(header, "D0CF11E0"), hit("_Installers", "high", "magic-ole-msi")),
            (ext == ".msi", hit("_Installers", "high", "ext-msi")),
            (ext == ".exe", hit("_Installers", "low", "ext-exe-no-mz")),
            (ext.isin(*DOCUMENTS), hit("_Documents", "high", tagged("ext-", bare))),
            (ext.isin(*PLUGINS), hit("_GameMods", "high", tagged("ext-", bare))),
            (ext == ".pak", hit("_GameMods", "low", "ext-pak")),
            (is_map & (picture.isNotNull() | ext.isin(*IMAGES)), hit("_Maps", "low", "name-map")),
            (packed.isNotNull(), hit("_Archives", "high", tagged("magic-", packed))),
            (ext.isin(*ARCHIVES), hit("_Archives", "high", tagged("ext-", bare))),
            (picture.isNotNull(), hit("_Images", "low", tagged("magic-", picture))),
            (ext.isin(*IMAGES), hit("_Images", "low", tagged("ext-", bare))),
        ],
        hit("_Unknown", "unsure", "none"),
    )


def match_hints(name: Column, hints: dict[str, list[str]]) -> Column:
    """struct<bin, confidence, rule>: the one sub-bin with a hint in the name; several are ambiguous."""
    lower = F.lower(name)
    hit = [F.when(reduce(lambda a, b: a | b, [lower.contains(h.lower()) for h in words if h], F.lit(False)), F.lit(sub)) for sub, words in hints.items()]
    found = F.array_compact(F.array(*hit))
    answer = lambda where, sure, rule: F.struct(where.alias("bin"), F.lit(sure).alias("confidence"), rule.alias("rule"))
    return first_of(
        [(F.size(found) == 1, answer(found[0], "high", F.concat(F.lit("hint-"), found[0]))), (F.size(found) > 1, answer(F.lit("_Unknown"), "unsure", F.lit("hint-ambiguous")))],
        answer(F.lit("_Unknown"), "unsure", F.lit("no-hint")),
    )


def combine(rule_bin: Column, rule_confidence: Column, first: Column, second: Column) -> Column:
    """struct<bin, confidence> from a rule and up to two model answers (null: not asked).

    No answer leaves the rule; an unsure answer makes it unsure; an answer that agrees with a sure rule, or two
    that agree with each other, win high; anything else is low and keeps the rule's bin.
    """
    answer = lambda where, sure: F.struct(where.alias("bin"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))
    return first_of(
        [
            (first.isNull(), answer(rule_bin, rule_confidence)),
            (first == "Unsure", answer(rule_bin, "unsure")),
            ((rule_confidence != "unsure") & (first == rule_bin), answer(first, "high")),
            (second == "Unsure", answer(rule_bin, "unsure")),
            (second == first, answer(first, "high")),
        ],
        answer(rule_bin, "low"),
    )


def response_label(raw: Column) -> Column:
    """The label in a model's answer: of its message's text, itself JSON or plain, or of the answer; null without one."""
    content = F.get_json_object(raw, "$.message.content")
    of = lambda text: F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("bin", "label", "type")])
    plain = F.when(~F.trim(content).rlike(r"^[{\[]"), F.nullif(F.trim(content), F.lit("")))
    return F.coalesce(of(content), plain, of(raw))
