"""Column functions of the track catalogue. All stay in the JVM but the Unicode foldings of ``identity_unicode`` and ``device_path``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
AUDIO_SUFFIXES = [".mp3", ".mp4", ".m4a", ".aac", ".wav", ".flac", ".ogg", ".oga", ".aif", ".aiff", ".webm"]
PSEUDO_SCHEMES = ["spotify:", "soundcloud:", "itunes:", "tidal:", "youtube:", "http://", "https://"]
CONTAINER_FOLDERS = ["contents", "music", "unknown artist"]
MOODS = ["warm", "euphoric", "dark", "dreamy", "hypnotic"]
TEXTURES = ["raw", "atmospheric", "minimal", "percussive", "vocal"]
ENERGIES = ["low", "medium", "peak", "driving"]
MOOD_RULES = [("techno|industrial|hypnotic|acid", "dark"), ("progressive|trance|peak", "euphoric"), ("ambient|downtempo|organic|melodic|dream", "dreamy"), ("deep|disco|soulful|afro", "warm"), ("g-house|tech house|garage", "hypnotic")]
TEXTURE_RULES = [("vocal|singer", "vocal"), ("ambient|melodic|organic|atmospheric", "atmospheric"), ("minimal", "minimal"), ("techno|tech|percuss|drum", "percussive"), ("raw|acid|industrial", "raw")]
CONTENT_TYPES = [(r"\.mp3$", "audio/mpeg"), (r"\.wav$", "audio/wav"), (r"\.flac$", "audio/flac"), (r"\.(m4a|aac)$", "audio/mp4"), (r"\.aiff?$", "audio/aiff"), (r"\.ogg$", "audio/ogg")]
DIMENSIONS = ["overall", "drums", "bass", "melodic_palette", "groove", "production_space", "mix_compatibility"]
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def text(c: Column) -> Column:
    """Missing text is the empty string."""
    return F.coalesce(c, F.lit(""))


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def filename_parts(path: Column, root: Column) -> Column:
    """struct(artist, title): from "artist - title", else from the folder two above the file, else the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    parts = F.split(stem, r"(?:\s+-\s*|\s*-\s+)", 2)
    left, right = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    split = (F.size(parts) == 2) & (left != "") & (right != "")
    below = F.split(F.substring(path, F.length(root) + 2, F.length(path)), "/")
    folder = F.trim(F.when(path.startswith(F.concat(root, F.lit("/"))) & (F.size(below) >= 3), F.element_at(below, -3)))
    named = (folder != "") & ~F.lower(folder).isin(CONTAINER_FOLDERS)
    whole = F.when(stem != "", stem).otherwise(name)
    return F.struct(F.when(split, left).when(named, folder).otherwise("").alias("artist"), F.when(split, right).otherwise(whole).alias("title"))


def location_kind(location: Column) -> Column:
    place = F.trim(text(location))
    return F.when(place == "", "empty").when(F.lower(place).rlike("^(" + "|".join(PSEUDO_SCHEMES) + ")"), "pseudo").otherwise("file")


def identity_part(value: Column) -> Column:
    """Letters and digits in lower case: the form by which titles and artists are matched (ASCII)."""
    return F.lower(F.regexp_replace(text(value), r"[^\p{L}\p{N}]", ""))


def identity_unicode():
    """The same for any text: compatibility forms and accents are folded too."""
    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        import regex

        drop = regex.compile(r"[^\p{L}\p{N}]+")

        def one(x):
            first = drop.sub("", unicodedata.normalize("NFC", x or ""))
            return first.lower() if first.isascii() else drop.sub("", unicodedata.normalize("NFKD", first).casefold())

        return values.map(one)

    return fold


def canonical_key(key: Column) -> Column:
    """Camelot key without leading zeros; other text upper-cased without spaces."""
    compact = F.upper(F.regexp_replace(text(key), r"\s", ""))
    number = F.regexp_extract(compact, "^0*([1-9]|1[0-2])([AB])$", 1)
    return F.when(number != "", F.concat(number, F.right(compact, F.lit(1)))).otherwise(compact)


def display_key(key: Column) -> Column:
    trimmed = F.trim(key)
    number = F.regexp_extract(F.upper(trimmed), r"^0?(\d{1,2})([AB])$", 1)
    return F.when(number != "", F.concat(number.cast("int").cast("string"), F.right(F.upper(trimmed), F.lit(1)))).otherwise(trimmed)


def key_neighbours(key: Column) -> Column:
    """The keys one step away on the wheel of twelve, and the one across; none for other text."""
    number, letter = F.regexp_extract(key, r"^(\d{1,2})([AB])$", 1).try_cast("int"), F.right(key, F.lit(1))
    around = F.array(F.when(number == 1, 12).otherwise(number - 1), F.when(number == 12, 1).otherwise(number + 1))
    keys = F.concat(F.transform(around, lambda n: F.concat(n.cast("string"), letter)), F.array(F.concat(number.cast("string"), F.when(letter == "A", "B").otherwise("A"))))
    return F.when(number.isNull(), F.array().cast("array<string>")).otherwise(keys)


def keys_compatible(a: Column, b: Column) -> Column:
    present = (text(a) != "") & (text(b) != "")
    return present & F.coalesce((a == b) | F.array_contains(key_neighbours(a), b), F.lit(False))


def canonical_genre(genre: Column) -> Column:
    trimmed = F.trim(text(genre))
    return F.when(trimmed.rlike(r"(?i)^nu[\s-]*disco$"), "Nu Disco").otherwise(trimmed)


def mood(genre: Column) -> Column:
    out, value = F.lit("warm"), F.lower(text(genre))
    for pattern, name in reversed(MOOD_RULES):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def energy(level: Column) -> Column:
    return F.when(level.isNull(), "medium").when(level <= 2, "low").when(level <= 4, "medium").when(level <= 6, "driving").otherwise("peak")


def textures(genre: Column) -> Column:
    value = F.lower(text(genre))
    found = F.array_compact(F.array(*[F.when(value.rlike(pattern), name) for pattern, name in TEXTURE_RULES]))
    return F.when(F.size(found) == 0, F.array(F.lit("minimal"))).otherwise(found)


def studio_fields(genre: Column, key: Column, bpm: Column, level: Column) -> dict[str, Column]:
    """What the studio shows of a tag record."""
    g = canonical_genre(genre)
    k = F.when(text(key) != "", display_key(key))
    named = F.when(g == "", "warm").otherwise(mood(g))
    found = F.when(g == "", F.array(F.lit("minimal"))).otherwise(textures(g))
    known = k.isNotNull() | (g != "") | (F.coalesce(bpm, F.lit(0.0)) != 0) | level.isNotNull()
    return {
        "genre": g,
        "key": k,
        "mood": named,
        "energy": energy(level),
        "textures": found,
        "tags": F.slice(F.concat(F.array(F.when(g == "", named).otherwise(g), energy(level)), found), 1, 4),
        "analysis_status": F.when(known, "ok").otherwise("missing-metadata"),
        "cluster_name": F.when(g == "", "Demo library").otherwise(g),
    }


def tag_bpm(tags: Column) -> Column:
    """First positive number of the tempo tags."""
    return F.coalesce(*[F.when(v > 0, v) for v in (finite(tags[name].try_cast("double")) for name in ("bpm", "tbpm"))])


def tag_key(tags: Column) -> Column:
    """First key tag: the key of base64-encoded JSON, else the text if it is short."""

    def one(value: Column) -> Column:
        compact = F.regexp_replace(value, r"\s", "")
        padded = F.rpad(compact, (F.ceil(F.length(compact) / 4) * 4).cast("int"), F.lit("="))
        decoded = F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.key")
        return F.coalesce(F.nullif(F.trim(decoded), F.lit("")), F.when((F.trim(value) != "") & (F.length(F.trim(value)) <= 16), F.trim(value)))

    return F.coalesce(*[one(tags[name]) for name in ("initialkey", "tkey", "key")])


def device_path():
    """A path as devices and exports agree on it: slashes, composed characters, no root, casefolded."""
    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        def one(x):
            composed = unicodedata.normalize("NFC", (x or "").replace("\\", "/").strip())
            return "/".join(p for p in composed.split("/") if p not in ("", ".")).casefold() or "."

        return values.map(one)

    return fold


def content_type(object_key: Column) -> Column:
    out, value = F.lit("application/octet-stream"), F.lower(object_key)
    for pattern, name in reversed(CONTENT_TYPES):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def fnv1a(value: Column, start: int = FNV_OFFSET) -> Column:
    """32-bit FNV-1a over a text's UTF-16 units, as a long."""
    units = F.regexp_extract_all(F.hex(F.encode(value, "UTF-16BE")), F.lit("(.{4})"))
    codes = F.when(F.octet_length(value) == F.char_length(value), F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.transform(units, lambda u: F.conv(u, 16, 10).cast("long")))
    return F.aggregate(codes, F.lit(start).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit((1 << 32) - 1)))


def hash_unit(value: Column) -> Column:
    return fnv1a(value) / float(1 << 32)


def hash_angle(value: Column) -> Column:
    return hash_unit(value) * F.lit(6.283185307179586)


def hash_point(value: Column, base: float, steps: int, per: float) -> Column:
    """struct(x, y) on a ring: whole degrees, radius base + (hash mod steps) / per."""
    h = fnv1a(value)
    angle, radius = F.radians((h % 360).cast("double")), F.lit(base) + (h % steps) / F.lit(per)
    return F.struct((F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def fit_dim(vector: Column, dim: int) -> Column:
    """Padded with zeros, or trimmed, to dim values."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """A unit vector; null if a value isn't finite or all are zero. The length is summed once, in the fold that ends in the division."""
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"), lambda s: F.when((s > 0) & ~F.isnan(s) & (s < float("inf")), F.transform(vector, lambda x: x.cast("double") / F.sqrt(s))))


def suggested_moment(bpm: Column, energy_pct: Column, valence_pct: Column) -> Column:
    b = F.when(F.coalesce(finite(bpm), F.lit(0.0)) == 0, 122.0).otherwise(bpm)
    return (
        F.when((b < 116) & (energy_pct < 0.45), "Sunrise / ambient open")
        .when((b < 122) & (valence_pct >= 0.5) & (energy_pct < 0.6), "Daytime beach club")
        .when((b < 124) & (energy_pct < 0.55), "Sunset / golden hour")
        .when((energy_pct >= 0.7) | (b >= 126), "Peak time")
        .when((valence_pct < 0.4) & (energy_pct >= 0.5), "Deep / afterhours")
        .otherwise("Main floor")
    )


def readiness(state: Column, total: Column, done: Column, running: Column, failed: Column) -> Column:
    """From the state if it says so, else from counts of stages (nulls count as none)."""
    s, zero = F.trim(text(state)), F.lit(0)
    t, d, r, f = (F.coalesce(c, zero) for c in (total, done, running, failed))
    counted = F.when(r > 0, "processing_fast").when(t == 0, "imported").when(d < t, "queued").when(f >= t, "failed").when(f > 0, "degraded").otherwise("ready_fast")
    return (
        F.when(s.isin("failed", "queued", "processing_deep"), s)
        .when(s.isin("running", "processing_fast"), "processing_fast")
        .when(s.isin("ready_deep", "completed_deep"), "ready_deep")
        .when(s.isin("ready_fast", "completed", "succeeded"), "ready_fast")
        .otherwise(counted)
    )


def analysis_status(ready: Column, missing_metadata: Column) -> Column:
    return F.when(ready == "failed", "failed").when(ready.isin("ready_fast", "ready_deep", "degraded"), "ok").when(missing_metadata, "missing-metadata").otherwise("pending")


def preview_state(url: Column) -> Column:
    return F.when(text(url) == "", "missing").otherwise("ready")


def similarity_reasons(non_sonic: Column, codes: Column, score: Column) -> Column:
    """At most five struct(label, kind)."""
    item = lambda label, kind: F.struct(label.alias("label"), kind.alias("kind"))
    warning = F.array_compact(F.array(F.when(non_sonic, item(F.lit("Prototype map distance — not sonic analysis"), F.lit("warning")))))
    told = F.transform(F.filter(codes, lambda c: F.trim(c) != ""), lambda c: item(F.trim(F.regexp_replace(F.regexp_replace(c, "[_-]+", " "), r"\s+", " ")), F.lit("shared")))
    scored = F.array_compact(F.array(F.when(finite(score).isNotNull(), item(F.concat(F.format_string("%.2f", score), F.lit(" neighbor score")), F.when(score < 0.72, "warning").otherwise("distance")))))
    return F.slice(F.concat(warning, told, scored), 1, 5)


def reason_text(reasons: Column) -> Column:
    return F.concat_ws(" · ", F.transform(reasons, lambda r: r["label"]))


def evidence_key(prefix: Column, scope: Column, stem: Column, start_ms: Column, end_ms: Column) -> Column:
    interval = F.when(start_ms.isNotNull() & end_ms.isNotNull(), F.concat(start_ms.cast("string"), F.lit("-"), end_ms.cast("string"), F.lit("ms")))
    return F.concat_ws(":", prefix, scope, F.nullif(stem, F.lit("")), interval)


def cache_key(content_hash: Column, *identity: Column) -> Column:
    """Of content, extractor, plan and separator, not of the track; null without a content hash."""
    return F.when(text(content_hash) != "", F.sha2(F.concat_ws("|", content_hash, *[text(c) for c in identity]), 256))


def failure(exception: Column, message: Column) -> Column:
    """struct(code, retryable) by ordered rules over an exception's class and message."""
    name, said = F.lower(text(exception)), F.lower(text(message))
    rules = [
        (name == "engineunavailableerror", "engine_unavailable", False),
        (name == "sourcechangederror", "source_changed", False),
        (name == "filenotfounderror", "missing_audio", False),
        (name == "permissionerror", "audio_permission_denied", False),
        (name.contains("libsndfile") | said.contains("format not recognised"), "corrupt_audio", False),
        (name.isin("memoryerror", "timeouterror"), "resource_exhausted", True),
        (name.isin("oserror", "ioerror", "connectionerror", "brokenpipeerror", "connectionreseterror", "isadirectoryerror", "notadirectoryerror", "blockingioerror", "interruptederror", "fileexistserror"), "transient_io", True),
        (name.contains("manifest") | said.contains("manifest"), "manifest_not_found", False),
        (name.contains("extractornotfound") | (said.contains("extractor") & said.contains("not registered")), "extractor_not_found", False),
        ((name == "valueerror") & said.rlike("decode|audio file|soundfile"), "corrupt_audio", False),
    ]
    out = F.struct(F.lit("extractor_failed").alias("code"), F.lit(False).alias("retryable"))
    for when, code, again in reversed(rules):
        out = F.when(when, F.struct(F.lit(code).alias("code"), F.lit(again).alias("retryable"))).otherwise(out)
    return out


def failure_reason(message: Column, limit: int = 2000) -> Column:
    return F.substring(F.trim(F.regexp_replace(text(message), r"\s+", " ")), 1, limit)


def prompt_bpm(prompt: Column) -> Column:
    low = F.lower(prompt)
    around, plain = F.regexp_extract(low, r"around\s+(\d{2,3})", 1), F.regexp_extract(low, r"(\d{2,3})\s*bpm", 1)
    return F.coalesce(F.nullif(around, F.lit("")), F.nullif(plain, F.lit(""))).cast("int")


def prompt_filters(prompt: Column, low_bpm: Column, high_bpm: Column) -> dict[str, Column]:
    """A prompt's structured filter and what it was read from."""
    low = F.lower(prompt)
    centre = prompt_bpm(prompt)
    within = lambda c: F.when(centre.isNotNull(), F.least(F.greatest(c, low_bpm), high_bpm))
    key = F.nullif(F.regexp_extract(F.upper(prompt), r"\b(\d{1,2}[AB])\b", 1), F.lit(""))
    among = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    moods = among(MOODS)
    moods = F.when(low.rlike(r"\bdarker\b") & ~F.array_contains(moods, "dark"), F.array_append(moods, "dark")).otherwise(moods)
    found = among(TEXTURES)
    energies = F.when(low.rlike(r"\braise energy|peak|driving\b"), F.array(F.lit("peak"), F.lit("driving"))).otherwise(among(ENERGIES))
    vibe = F.concat(moods, found)
    evidence = F.array_compact(F.array(F.when(centre.isNotNull(), F.concat(centre.cast("string"), F.lit(" BPM ±4"))), key, F.when(F.size(vibe) > 0, F.concat_ws(" · ", vibe)), F.lit("colored by mood")))
    return {"bpm_min": within(centre - 4), "bpm_max": within(centre + 4), "key": key, "moods": moods, "textures": found, "energies": energies, "evidence": evidence}


def looks_like_question(prompt: Column) -> Column:
    said = F.trim(text(prompt))
    return (said != "") & (said.rlike(r"(?i)\b(find|around|warmer|darker|raise|energy|percussive|similar|after this)\b") | (F.size(F.split(said, r"\s+")) >= 5))


def clamp_filters(bpm_min: Column, bpm_max: Column, low: Column, high: Column) -> Column:
    """struct(bpm_min, bpm_max), rounded, inside the bounds and in order; null where neither is given."""
    clamp = lambda c: F.least(F.greatest(F.floor(c + 0.5), low), high)
    a, b = clamp(F.coalesce(bpm_min, low)), clamp(F.coalesce(bpm_max, high))
    given = bpm_min.isNotNull() | bpm_max.isNotNull()
    return F.struct(F.when(given, F.least(a, b)).alias("bpm_min"), F.when(given, F.greatest(a, b)).alias("bpm_max"))


def filter_chips(bpm_min: Column, bpm_max: Column, keys: Column, vibe: Column) -> Column:
    span = F.when(bpm_min == bpm_max, F.concat(bpm_min.cast("string"), F.lit(" BPM"))).when(bpm_min.isNotNull() & bpm_max.isNotNull(), F.concat(bpm_min.cast("string"), F.lit("–"), bpm_max.cast("string"), F.lit(" BPM")))
    return F.array_compact(F.array(span, *[F.when(F.size(x) > 0, F.concat_ws(" · ", x)) for x in (keys, vibe)]))


def clamp_score(score: Column) -> Column:
    return F.when(finite(score).isNull(), 0.5).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def judgment_error(kind: Column, decision: Column, candidate_b: Column, ordinal: Column, dimension: Column) -> Column:
    """Why a judgment is invalid; null if it is valid."""
    pair = decision.isin("accepted", "rejected", "similar", "not_similar", "skip")
    has_b = text(candidate_b) != ""
    return (
        F.when(~dimension.isin(DIMENSIONS), "unsupported dimension")
        .when((kind == "triplet") & ~(has_b & decision.isin("a_closer", "b_closer", "tie", "skip")), "invalid triplet")
        .when(kind.isin("top_k", "pair_rating") & (has_b | ~pair), "invalid decision")
        .when((kind == "pair_rating") & ordinal.isNotNull() & ~ordinal.between(0, 4), "ordinal out of range")
        .when(~kind.isin("triplet", "top_k", "pair_rating"), "unsupported type")
    )


def judgment_alias(decision: Column) -> Column:
    return F.when(decision == "accepted", "similar").when(decision == "rejected", "not_similar").otherwise(decision)


def allowed_object_key(key: Column, prefixes: list[str]) -> Column:
    trimmed = F.trim(text(key))
    inside = F.lit(False)
    for prefix in prefixes:
        inside = inside | trimmed.startswith(prefix)
    return inside & ~trimmed.startswith("/") & ~F.exists(F.split(trimmed, "/"), lambda part: part == "..")


def object_entry(key: Column) -> dict[str, Column]:
    """Catalogue entry of an audio object's key."""
    trimmed = F.trim(key)
    parts = F.filter(F.split(trimmed, "/"), lambda p: p != "")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    at = F.array_position(parts, "Contents")
    folder = F.trim(F.when(at > 0, F.get(parts, at.cast("int"))))
    folder = F.when((folder != "") & (folder != "UnknownAlbum"), folder)
    split = F.split(stem, " - ", 2)
    both = F.size(split) == 2
    plain = F.trim(F.replace(stem, F.lit("_"), F.lit(" ")))
    return {
        "id": F.concat(F.lit("r2-"), *[F.lpad(F.lower(F.hex(fnv1a(trimmed, start))), 8, "0") for start in (FNV_OFFSET, 5381)]),
        "artist": F.coalesce(folder, F.when(both, F.nullif(F.trim(split[0]), F.lit(""))), F.lit("Unknown artist")),
        "title": F.coalesce(F.when(both, F.nullif(F.trim(F.get(split, F.lit(1))), F.lit(""))), F.nullif(plain, F.lit("")), stem),
    }


def exact_round(x, places: int):
    """x to so many places by the double's exact value, halves to even; not by its shortest text, as ``round`` does.

    The fraction is cut into three whole numbers of 30 bits, which loses nothing that can decide about a half.
    """
    size = F.abs(x)
    whole = F.floor(size)
    parts, rest = [], size - whole
    for _ in range(3):
        rest = rest * float(1 << 30)
        parts.append(F.floor(rest))
        rest = rest - parts[-1]
    number = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    total = sum((p.cast("decimal(38,0)") * number(1 << 60 - 30 * i) for i, p in enumerate(parts)), number(0)) * number(10**places)
    total, unit = total.cast("decimal(38,0)"), number(1 << 90)
    down = F.floor(total / unit)
    down = F.when(total < down * unit, down - 1).when(total >= (down + 1) * unit, down + 1).otherwise(down)  # a quotient may be rounded
    twice = (total - down * unit) * 2
    up = F.when((twice > unit) | ((twice == unit) & (down % 2 == 1)), 1).otherwise(0)
    value = (whole * 10**places + down.cast("long") + up).cast("double") / float(10**places)
    return F.when(size < 1e9, F.when(x < 0, -value).otherwise(value)).otherwise(x)
