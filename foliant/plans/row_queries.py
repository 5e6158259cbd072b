"""Functions of one row over columns of the tables: inputs are expressions that both engines read alike, the SQL states each rule anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, guards, names, numbers, paths, posts, records, sniff, web
from ..operators import feed, library, parts, staging, tagging
from ..sources import documents
from . import views
from .registry import ORACLES, QUERIES


def rule(name: str, table: str, key: str, given: dict[str, str], function: Callable[..., Column], kind: str, sql: str, spark_given: dict[str, str] | None = None) -> None:
    """Register ``function`` of the columns ``given`` (name to expression over the table) under ``name``; ``sql`` is its value in DuckDB.

    ``spark_given`` replaces those expressions that Spark reads otherwise: its casts from double to whole numbers cut, DuckDB's round half to even.
    """

    def run(spark, sf_dir):
        rows = views.table(spark, sf_dir, table).select(F.expr(key).alias("id"), *[F.expr(e).alias(n) for n, e in (given | (spark_given or {})).items()])
        return rows.select("id", function(*[F.col(n) for n in given]).cast(kind).alias("out"))

    QUERIES[name] = run
    cast = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}[kind]
    ORACLES[name] = f"WITH x AS (SELECT {key} AS id, {', '.join(f'{e} AS {n}' for n, e in given.items())} FROM {table}) SELECT id, CAST({sql} AS {cast}) AS out FROM x"


# part names with endings of six kinds, and paths of them
NAME = "CASE p_partkey % 6 WHEN 0 THEN p_name || '.png' WHEN 1 THEN upper(p_name) || '.JPG' WHEN 2 THEN p_name || '.tar.gz' WHEN 3 THEN p_brand || '.zip' WHEN 4 THEN '.' || p_name ELSE p_name END"
REL = f"p_type || '/' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || '/' END || CASE WHEN p_size % 5 = 0 THEN 'deep/er/' ELSE '' END || {NAME}"
WORD = "CASE p_size % 6 WHEN 0 THEN p_brand WHEN 1 THEN 'CON' WHEN 2 THEN p_type || '/x' WHEN 3 THEN p_name || '.' WHEN 4 THEN '' ELSE p_name END"
BARE_URL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"


def part(name: str, given: dict[str, str], function: Callable[..., Column], kind: str, sql: str) -> None:
    rule(name, "part", "p_partkey", given, function, kind, sql)


part("name_extensions", {"n": NAME, "k": "p_partkey % 6"}, lambda n, k: posts.name_extension(n), "string", "CASE k WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gz' WHEN 3 THEN '.zip' ELSE '' END")
part("suffixes", {"n": NAME, "k": "p_partkey % 6"}, lambda n, k: paths.suffix(n), "string", "CASE k WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.gz' WHEN 3 THEN '.zip' ELSE '' END")
part("archive_formats", {"n": NAME, "e": "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'zip' ELSE 'rar' END", "k": "p_partkey % 6"}, lambda n, e, k: guards.archive_format(n, e), "string", "CASE WHEN e = 'zip' THEN 'zip' WHEN e = 'rar' THEN NULL WHEN k = 2 THEN 'tar.gz' WHEN k = 3 THEN 'zip' END")
part("proxy_suffixes", {"n": NAME, "k": "p_partkey % 6"}, lambda n, k: records.proxy_suffix(n), "string", "CASE k WHEN 0 THEN '.png' ELSE '.jpg' END")
part("scannable_images", {"n": "p_name || CASE WHEN p_size % 5 = 0 THEN '_PROXY' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '.PNG' WHEN p_partkey % 3 = 1 THEN '.jpg' ELSE '.txt' END", "k": "p_partkey % 3", "s": "p_size % 5"}, lambda n, k, s: guards.scannable(n, (".png", ".jpg"), "_proxy"), "boolean", "k < 2 AND s <> 0")
part("media_kinds", {"n": NAME, "s": "CASE WHEN p_size % 3 = 0 THEN 'image' ELSE 'attachment' END", "m": "CASE p_size % 7 WHEN 0 THEN ' Application/ZIP; x' WHEN 1 THEN 'image/x' END", "k": "p_partkey % 6"}, lambda n, s, m, k: web.media_kind(n, s, m), "string", "CASE WHEN k = 3 OR m LIKE '%ZIP%' THEN 'zip' WHEN s = 'image' OR m = 'image/x' OR k < 2 THEN 'loose-media' ELSE 'other' END")
part("image_looks", {"n": NAME, "m": "CASE p_size % 7 WHEN 0 THEN 'IMAGE/x' WHEN 1 THEN 'application/zip' END", "u": "CASE WHEN p_size % 4 = 0 THEN 'https://h.example/' || p_partkey || '.GIF?x=1' END", "k": "p_partkey % 6"}, lambda n, m, u, k: posts.looks_like_image(n, m, u), "boolean", "k < 2 OR coalesce(m = 'IMAGE/x', false) OR u IS NOT NULL")
part("downloadables", {"n": NAME, "m": "CASE WHEN p_size % 5 = 0 THEN 'application/pdf' END", "u": "CASE WHEN p_size % 4 = 0 THEN '' ELSE 'https://h.example/' || p_partkey END", "k": "p_partkey % 6"}, lambda n, m, u, k: posts.downloadable(n, m, u), "boolean", "u <> '' AND (k = 3 OR (k IN (4, 5) AND m IS NOT NULL))")
part("ensured_extensions", {"n": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE ' ' || p_name || CASE WHEN p_size % 3 = 1 THEN '.zip' ELSE '' END || ' ' END", "u": "'https://h.example/f/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.pdf' ELSE '' END", "m": "CASE WHEN p_partkey % 5 = 0 THEN 'image/png' END", "s": "p_size % 3", "k": "p_partkey"}, lambda n, u, m, s, k: posts.with_extension(n, u, m), "string", "CASE s WHEN 1 THEN trim(n) ELSE CASE s WHEN 0 THEN CAST(k AS VARCHAR) ELSE trim(n) END || CASE WHEN k % 2 = 0 THEN '.pdf' WHEN m IS NOT NULL THEN '.png' ELSE '' END END")
part("mime_extensions", {"m": "CASE p_size % 5 WHEN 0 THEN 'image/JPEG; q=1' WHEN 1 THEN ' video/quicktime ' WHEN 2 THEN 'application/zip' WHEN 3 THEN p_type ELSE NULL END", "s": "p_size % 5"}, lambda m, s: posts.mime_extension(m), "string", "CASE s WHEN 0 THEN '.jpg' WHEN 1 THEN '.mov' WHEN 2 THEN '.zip' ELSE '' END")
part("marker_indexes", {"m": "CASE p_partkey % 4 WHEN 0 THEN chr(97 + p_size % 26) WHEN 1 THEN upper(chr(97 + p_size % 26)) WHEN 2 THEN CAST(p_size AS STRING) ELSE p_brand END", "k": "p_partkey % 4", "s": "p_size"}, lambda m, k, s: numbers.marker_index(m), "bigint", "CASE k WHEN 2 THEN s WHEN 3 THEN -1 ELSE s % 26 END")
part("retry_headers", {"h": "CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN '-' || p_size WHEN 2 THEN p_name END", "k": "p_partkey % 4", "s": "p_size"}, lambda h, k, s: numbers.retry_after(h), "bigint", "CASE k WHEN 0 THEN s END")
part("sanitized_names", {"v": "' ' || p_brand || ':' || p_name || CASE WHEN p_size % 2 = 0 THEN '? .' ELSE '. ' END"}, lambda v: paths.sanitized(v), "string", "rtrim(replace(replace(trim(v), ':', '_'), '?', '_'), ' .')")
part("set_folders", {"r": REL, "a": "p_type", "b": "p_brand", "s": "p_size"}, lambda r, a, b, s: paths.set_directory(r, 2), "string", "CASE WHEN s % 3 <> 0 THEN a || '/' || b WHEN s % 5 = 0 THEN a || '/deep' ELSE a END")
part("folder_slugs", {"v": "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'con' WHEN 2 THEN p_name || '.' ELSE '.' || p_name END", "k": "p_size % 4"}, lambda v, k: posts.folder_safe(v), "boolean", "k = 0")
part("safe_segments", {"v": WORD, "k": "p_size % 6"}, lambda v, k: guards.safe_segment(v), "boolean", "k IN (0, 1, 5)")
part("subbin_names", {"v": f"CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_name ELSE {WORD} END", "k": "p_size % 6", "s": "p_partkey % 7"}, lambda v, k, s: guards.subbin_name(v), "boolean", "s <> 0 AND k NOT IN (2, 4)")
part("absolute_paths", {"v": f"CASE p_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN 'C:/' WHEN 2 THEN 'c:' WHEN 3 THEN '//srv/' ELSE '' END || {REL}", "k": "p_partkey % 5"}, lambda v, k: guards.is_absolute(v), "boolean", "k IN (0, 1, 3)")
part("member_escapes", {"v": f"CASE p_size % 4 WHEN 0 THEN '../' WHEN 1 THEN 'a/../' WHEN 2 THEN 'a/../../' ELSE '' END || {REL}", "l": "p_type", "k": "p_size % 4"}, lambda v, l, k: guards.escapes(v, F.array(F.when(F.length(l) % 2 == 0, l).otherwise("none"))), "boolean", "k IN (0, 2) OR (k = 3 AND length(l) % 2 = 0)")
part("glob_excludes", {"r": REL, "k": "p_partkey % 6", "s": "p_size"}, lambda r, k, s: guards.excluded_by(r, ["*.gz", "deep", "ECONOMY/*.zip"]), "string", "CASE WHEN k = 2 THEN '*.gz' WHEN s % 5 = 0 THEN 'deep' WHEN k = 3 AND r LIKE 'ECONOMY/%' THEN 'ECONOMY/*.zip' END")
part("write_guards", {"d": f"CASE p_size % 4 WHEN 0 THEN '/library/' WHEN 1 THEN '/LIBRARY/keep/' WHEN 2 THEN '/librarian/' ELSE '/quarantine/' END || {REL}", "k": "p_size % 4"}, lambda d, k: guards.may_write(d, ["/library", "/quarantine"], ["/library/keep"]), "boolean", "k IN (0, 3)")
part("staging_refusals", {"d": f"CASE p_size % 4 WHEN 0 THEN '/w/.GIT/' WHEN 1 THEN '/library/' WHEN 2 THEN '/ex/' ELSE '/w/' END || {REL}", "k": "p_size % 4"}, lambda d, k: guards.staging_refusal(d, "/library", "/ex"), "string", "CASE k WHEN 0 THEN 'under .git' WHEN 1 THEN 'inside the library' WHEN 2 THEN 'among the examples' END")
part("git_paths", {"d": f"CASE p_size % 3 WHEN 0 THEN '/a/.Git/' WHEN 1 THEN '/x.git/' ELSE '/' END || {REL}", "k": "p_size % 3"}, lambda d, k: paths.in_folder_named(d, ".git"), "boolean", "k = 0")
part("combined_names", {"r": f"CASE p_size % 3 WHEN 0 THEN 'x/Combined High/' WHEN 1 THEN 'a_COMBINED' ELSE 'com/bined/' END || {REL}", "k": "p_size % 3"}, lambda r, k: parts.says_combined(r), "boolean", "k < 2")
part("zip_policies", {"c": "p_size % 2 = 0", "f": "CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'partial' END"}, lambda c, f: F.concat_ws(",", *[parts.should_zip(m, c, f).cast("string") for m in ("none", "all", "combined", "combined-with-parts")]), "string", "'false,true,' || c::VARCHAR || ',' || (c AND f = 'yes')::VARCHAR")
part("fitted_sizes", {"w": "p_partkey * 7 + 1", "h": "p_size * 50 + 1"}, lambda w, h: F.concat_ws("x", parts.fit_within(w, h, 1000)["width"], parts.fit_within(w, h, 1000)["height"]), "string", "greatest(1, round_even(w * least(1.0::DOUBLE, 1000.0::DOUBLE / greatest(w, h)), 0)::INT) || 'x' || greatest(1, round_even(h * least(1.0::DOUBLE, 1000.0::DOUBLE / greatest(w, h)), 0)::INT)")
part("area_percents", {"a": "p_size", "t": "p_partkey % 60"}, lambda a, t: numbers.area_percent(a, t), "bigint", "CASE WHEN t > 0 THEN round_even(100.0::DOUBLE * a / t, 0) ELSE 0 END")
part("expected_places", {"r": REL, "o": "CASE WHEN p_partkey % 2 = 0 THEN 'original-zip' ELSE 'file' END", "k": "p_partkey % 6"}, lambda r, o, k: records.expected_place("/t", r, o), "string", "'/t/' || CASE o WHEN 'file' THEN r ELSE '_Originals_Zipped/' || regexp_replace(r, '[^/]*$', '') || replace(CASE k WHEN 0 THEN regexp_extract(r, '([^/]*)\\.png$', 1) WHEN 2 THEN regexp_extract(r, '([^/]*)\\.gz$', 1) ELSE regexp_extract(r, '([^/]*)$', 1) END, ' ', '_') || '.zip' END")
part("content_names", {"n": NAME, "d": "'0123456789abcdef' || p_brand", "p": "p_size % 2 = 0", "q": "p_size % 4 = 0", "k": "p_partkey % 6"}, lambda n, d, p, q, k: posts.content_name(n, d, p, q), "string", "CASE WHEN NOT p THEN n ELSE CASE k WHEN 0 THEN n[:-5] WHEN 1 THEN n[:-5] WHEN 2 THEN n[:-4] WHEN 3 THEN n[:-5] ELSE n END || '__' || CASE WHEN q THEN '0123456789abcdef' ELSE '01234567' END || CASE k WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.gz' WHEN 3 THEN '.zip' ELSE '' END END")
part("post_folders", {"i": "CAST(p_partkey AS STRING)", "t": "CASE p_size % 3 WHEN 0 THEN p_name || ': day' WHEN 1 THEN NULL ELSE '...' END"}, lambda i, t: posts.post_folder(i, t), "string", "CASE WHEN t LIKE '%day' THEN i || '_' || replace(t, ':', '_') ELSE i || '_' || i END")
part("model_addresses", {"u": "CASE p_size % 5 WHEN 0 THEN 'http://localhost:' || p_partkey WHEN 1 THEN 'HTTPS://127.0.0.1/' || p_brand WHEN 2 THEN 'http://[::1]:8/x' WHEN 3 THEN 'http://localhost.' || p_name ELSE NULL END", "k": "p_size % 5"}, lambda u, k: guards.local_model(u), "boolean", "k < 3")
part("model_names", {"n": "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN ' ' WHEN 2 THEN 'is-Blocked-' || p_brand ELSE NULL END", "k": "p_size % 4"}, lambda n, k: guards.model_name(n, ("blocked",)), "boolean", "k = 0")
part("model_fields", {"s": "CASE p_size % 3 WHEN 0 THEN 'disabled' WHEN 1 THEN 'ok' ELSE 'unavailable' END", "l": "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END"}, lambda s, l: records.model_field(s, l), "string", "CASE WHEN s <> 'ok' THEN s WHEN l <> '' THEN s || '=' || l ELSE 'ok:not-called' END")
part("sidecar_ratings", {"b": "p_brand", "s": "p_type", "c": "CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'unsure' ELSE p_name END", "k": "p_size % 4"}, lambda b, s, c, k: records.sidecar(b, s, c)["rating"], "bigint", "CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END")
part("sidecar_subjects", {"b": "p_brand", "s": "CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN '' END"}, lambda b, s: F.array_join(records.sidecar(b, s, F.lit("low"))["subjects"], "|"), "string", "b || CASE WHEN s <> '' THEN '|' || s ELSE '' END")
part("action_texts", {"n": "p_size % 4", "z": "p_partkey % 2 = 0"}, lambda n, z: records.action_text(n, z), "string", "CASE WHEN n > 0 THEN 'recreate ' || n || ' parts + overview + zip' WHEN z THEN 'overview + zip' ELSE 'stand-in only' END")
part("tag_eligibility", {"b": "CASE WHEN p_size % 3 = 0 THEN p_type ELSE '_Maps' END", "c": "CASE WHEN p_partkey % 3 = 0 THEN 'low' ELSE 'high' END", "p": f"CASE WHEN p_size % 4 = 0 THEN '/a/.git/' ELSE '/a/' END || {NAME}", "s": "p_size", "k": "p_partkey"}, lambda b, c, p, s, k: tagging.eligible(b, c, p)["reason"], "string", "CASE WHEN s % 4 = 0 THEN 'refused: path under .git' WHEN k % 3 = 0 THEN 'not high confidence' WHEN s % 3 = 0 THEN 'unknown bin' ELSE '' END")
part("temporary_names", {"n": "p_name || '.zip' || CASE p_size % 4 WHEN 0 THEN '.partial' WHEN 1 THEN '.part1' WHEN 2 THEN '.bad2' ELSE '' END", "m": "p_name || '.zip'", "k": "p_size % 4"}, lambda n, m, k: names.temporary_target(n), "string", "CASE WHEN k < 3 THEN m END")
part("backup_names", {"n": NAME, "d": "lower(p_type)", "h": "p_size % 3"}, lambda n, d, h: records.backup_name(n, d, F.slice(F.array(F.concat_ws(".", n, d, F.lit("bak")), F.concat_ws(".", n, d, F.lit("2.bak"))), F.lit(1), h.cast("int"))), "string", "n || '.' || d || CASE h WHEN 0 THEN '.bak' WHEN 1 THEN '.2.bak' ELSE '.3.bak' END")
part("standin_sizes", {"s": "CAST(p_size AS BIGINT) * 1048576", "w": "1 + p_partkey % 9"}, lambda s, w: records.standin_megabytes(s, w * 100, w * 100, w * 50, w * 50), "string", "printf('%.3f', s * (w * 50 * w * 50) / (w * 100 * w * 100) / 1048576.0)")
part("source_names", {"p": "CASE p_size % 4 WHEN 0 THEN '/srv/' || p_brand WHEN 1 THEN chr(CAST(65 + p_partkey % 26 AS INT)) || ':/' WHEN 2 THEN '/' ELSE '/a/' || p_brand || ':' || p_type || '/' END", "b": "p_brand", "t": "p_type", "i": "p_partkey % 26", "k": "p_size % 4"}, lambda p, b, t, i, k: records.source_name(p), "string", "CASE k WHEN 0 THEN b WHEN 1 THEN chr(65 + i::INT) WHEN 2 THEN 'root' ELSE b || '_' || t END")

rule("url_tails", "pages", "page_id", {"u": "url"}, lambda u: posts.url_tail(u), "string", BARE_URL.replace("url", "u", 1).join(["list_last(string_split(rtrim(", ", '/'), '/'))"]))
rule("log_addresses", "pages", "page_id", {"u": "url"}, lambda u: web.loggable(u), "string", "split_part(split_part(u, '?', 1), '#', 1)")
rule("creator_names", "pages", "page_id", {"u": "regexp_replace(url, '/(en|de|fr|es)/', CASE page_id % 3 WHEN 0 THEN '/c/' WHEN 1 THEN '/user/' ELSE '/x/' END) || CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN '' ELSE '/about' END"}, lambda u: posts.creator_of(u), "string", "(WITH p AS (SELECT 1) SELECT list_last(list_filter(string_split(regexp_replace(regexp_replace(u, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), lambda s: s <> '' AND s <> 'about')) FROM p)")

rule("refine_slops", "lineitem", "l_orderkey * 8 + l_linenumber", {"w": "l_partkey * 7", "h": "l_suppkey * 90"}, lambda w, h: numbers.refine_slop(w, h), "bigint", "greatest(8, ceil(greatest(w, h) / 320.0::DOUBLE) + 2)")
rule("backoffs", "lineitem", "l_orderkey * 8 + l_linenumber", {"a": "l_linenumber + CAST(l_quantity AS INT) % 4", "r": "CASE l_suppkey % 3 WHEN 0 THEN NULL ELSE l_suppkey * 3 - 60 END"}, lambda a, r: numbers.backoff(a, r), "double", "least(120, coalesce(CASE WHEN r >= 0 THEN r::DOUBLE END, pow(2, a - 1)))")
rule("rounded_megabytes", "lineitem", "l_orderkey * 8 + l_linenumber", {"s": "l_partkey * 123457"}, lambda s: numbers.megabytes(s), "double", "round_even(s / 1048576.0::DOUBLE, 3)")
rule("rounded_megapixels", "lineitem", "l_orderkey * 8 + l_linenumber", {"s": "l_partkey * 1237 * l_linenumber + 1"}, lambda s: numbers.megapixels(s), "double", "round_even(s / 1000000.0::DOUBLE, 3)")
rule("finite_values", "orders", "o_orderkey", {"v": "CASE o_orderkey % 4 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE o_totalprice END"}, lambda v: numbers.finite(v), "double", "CASE WHEN isfinite(v) THEN v ELSE 0 END")
rule("size_caps", "orders", "o_orderkey", {"s": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS BIGINT) * 10 END", "m": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 3 END"}, lambda s, m: posts.too_big(s, m), "boolean", "coalesce(s > m * 1048576, false)", {"s": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(bround(o_totalprice) AS BIGINT) * 10 END"})
rule("kinds_or_other", "orders", "o_orderkey", {"k": "CASE o_orderkey % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'loose-media' WHEN 2 THEN 'other' WHEN 3 THEN o_orderpriority END", "n": "o_orderkey % 5"}, lambda k, n: posts.kind_or_other(k), "string", "CASE n WHEN 0 THEN 'zip' WHEN 1 THEN 'loose-media' ELSE 'other' END")
rule("statuses_or_failed", "orders", "o_orderkey", {"s": "CASE o_orderkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'locked' WHEN 2 THEN o_orderstatus END", "n": "o_orderkey % 4"}, lambda s, n: posts.status_or_failed(s), "string", "CASE n WHEN 0 THEN 'planned' WHEN 1 THEN 'locked' ELSE 'failed' END")
rule("summary_lines", "orders", "o_orderkey", {"c": "o_orderpriority", "a": "o_custkey % 3", "l": "o_orderkey % 4", "e": "o_custkey % 2", "d": "o_orderkey % 2"}, lambda c, a, l, e, d: posts.summary_line(c, a, l, e, d, a + l + e + d), "string", "CASE WHEN a + l + e + d = 0 THEN c || ': 0 posts in window' WHEN a = 0 AND e + d = 0 THEN c || ': 0 accessible posts in window (' || l || ' listed, ' || l || ' locked for your tier)' ELSE c || ': ' || a || ' accessible, ' || l || ' locked, ' || e || ' excluded, ' || d || ' deferred (' || (a + l + e + d) || ' listed)' END")
rule("site_gates", "orders", "o_orderkey", {"k": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "e": "CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"}, lambda k, e: guards.site_error(k, e), "string", "CASE WHEN k THEN CASE WHEN e THEN NULL ELSE 'site is disabled' END ELSE 'unknown site' END")
rule("session_errors", "orders", "o_orderkey", {"k": "CASE o_orderkey % 7 WHEN 0 THEN 'challenge' WHEN 1 THEN 'auth' WHEN 2 THEN 'rate' END", "s": "CASE o_custkey % 6 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 302 WHEN 4 THEN 204 ELSE 200 END", "x": "CASE WHEN o_custkey % 5 = 0 THEN 204 END", "v": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END", "n": "o_orderkey % 3 = 0"}, lambda k, s, x, v, n: guards.session_error(k, s, x, v, n), "string", "CASE WHEN k = 'challenge' THEN 'challenge' WHEN k = 'auth' OR s IN (401, 403) THEN 'auth' WHEN k = 'rate' OR s = 429 THEN 'rate' WHEN s <> coalesce(x, 200) THEN 'auth' WHEN n AND v = '' THEN 'auth' END")
rule("scan_arguments", "orders", "o_orderkey", {"a": "o_orderkey % 7 - 1", "m": "o_custkey % 5", "q": "o_custkey % 120", "r": "CAST(o_orderkey % 13 AS DOUBLE) / 10", "x": "CASE o_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'a/b' ELSE '_' || o_orderstatus END"}, lambda a, m, q, r, x: guards.scan_argument_error(a, F.lit(1), m, q, r, x), "string", "CASE WHEN a < 0 THEN 'thresholds' WHEN m < 1 THEN 'max_dim' WHEN q < 1 OR q > 100 THEN 'quality' WHEN x = '' OR x LIKE '%/%' THEN 'suffix' WHEN r > 1 THEN 'min_score' END")
rule("done_filter", "orders", "o_orderkey", {"s": "CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE o_orderstatus END", "p": "o_custkey % 3 = 0", "z": "CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END", "t": "o_orderkey % 3 = 0", "v": "o_orderkey % 5 < 3", "r": "CASE WHEN o_orderkey % 7 > 0 THEN true END"}, lambda s, p, z, t, v, r: guards.outputs_present(s, p, z, t, v, r), "boolean", "s = 'done' AND p AND (NOT coalesce(z, false) OR (t AND v AND coalesce(r, false)))")
rule("single_places", "orders", "o_orderkey", {"e": "o_orderkey % 3 > 0", "c": "CASE WHEN o_orderkey % 3 > 0 THEN lower(o_orderstatus) END", "s": "CASE o_custkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'o' ELSE 'x' END", "x": "CASE o_custkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'F' ELSE 'O' END", "n": "o_custkey % 5 < 2", "d": "o_orderkey % 2 = 0"}, lambda e, c, s, x, n, d: staging.single_status(e, c, s, x, n, d), "string", "CASE WHEN n AND e THEN 'exists' WHEN NOT n AND NOT e THEN 'missing' WHEN e AND c = s THEN 'unchanged' WHEN NOT n AND c <> lower(x) THEN 'stale' WHEN d THEN 'would-place' ELSE 'placed' END")
rule("log_snippets", "conversations", "conv_id * 100 + turn", {"t": "CASE WHEN turn = 0 THEN NULL ELSE text END"}, lambda t: posts.snippet(t), "string", "left(replace(replace(coalesce(t, ''), chr(13), ' '), chr(10), ' '), 200)")
rule("redacted_texts", "conversations", "conv_id * 100 + turn", {"t": "text", "s": "CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE substring(text, 2, 3) END"}, lambda t, s: posts.without_secret(t, s), "string", "CASE WHEN s <> '' THEN replace(t, s, '<redacted>') ELSE t END")

part("part_markers", {"t": "CASE p_partkey % 4 WHEN 0 THEN chr(CAST(97 + p_size % 26 AS INT)) WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN 'pt' || p_size ELSE p_type END", "k": "p_partkey % 4", "s": "p_size"}, lambda t, k, s: names.marker(t), "string", "CASE k WHEN 0 THEN t WHEN 1 THEN CASE WHEN s < 10 THEN t END WHEN 2 THEN CAST(s AS VARCHAR) END")
part("part_token_lists", {"v": "upper(p_name) || '__' || p_type || chr(39) || 's_' || p_size"}, lambda v: F.array_join(names.part_tokens(v), "|"), "string", "array_to_string(list_filter(string_split(replace(replace(lower(v), ' ', ''), chr(39), ''), '_'), lambda t: t <> ''), '|')")
part("family_keys", {"v": "p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_size END"}, lambda v: F.array_join(records.family_key(F.split(v, " ")), "|"), "string", "CASE WHEN len(string_split(v, ' ')) > 1 THEN array_to_string(string_split(v, ' ')[1:len(string_split(v, ' ')) - 1], '|') ELSE v END")
part("canonical_members", {"v": f"CASE p_size % 3 WHEN 0 THEN './' WHEN 1 THEN 'a//' ELSE '/./' END || {REL} || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END", "r": REL, "k": "p_size % 3"}, lambda v, r, k: paths.canonical_member(v), "string", "CASE k WHEN 1 THEN 'a/' ELSE '' END || r")
part("archive_file_names", {"v": f"replace(CASE WHEN p_size % 2 = 0 THEN '  _' ELSE '' END || {NAME}, ' ', '  ')", "n": NAME, "k": "p_partkey % 6"}, lambda v, n, k: paths.zip_archive_name(v, (".png", ".jpg")), "string", "replace(CASE k WHEN 0 THEN n[:-5] WHEN 1 THEN n[:-5] ELSE n END, ' ', '_') || '.zip'")
part("member_reasons", {"v": f"CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '/' || p_name WHEN 2 THEN 'c:/' || p_name WHEN 3 THEN p_type || '/../' || p_name WHEN 4 THEN p_name || '?' ELSE {NAME} END", "k": "p_size % 6"}, lambda v, k: paths.archive_member_reason(v), "string", "CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'absolute' WHEN 2 THEN 'drive' WHEN 3 THEN 'traversal' WHEN 4 THEN 'illegal' END")
part("retargeted_paths", {"v": "'Sets_' || CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'f' ELSE 'ptf' END || '/' || p_type || '_f_' || p_partkey || '.png'", "t": "p_type", "i": "p_partkey", "k": "p_size % 3"}, lambda v, t, i, k: library.retargeted(v, "f", "m"), "string", "'Sets_' || CASE k WHEN 0 THEN 'M' WHEN 1 THEN 'm' ELSE 'ptm' END || '/' || t || '_m_' || i || '.png'")
part("response_labels", {"v": "CASE p_size % 5 WHEN 0 THEN '{\"message\":{\"content\":\" ' || p_type || ' \"}}' WHEN 1 THEN '{\"bin\":\"' || p_brand || '\"}' WHEN 2 THEN '{\"type\":\"' || p_type || '\",\"label\":\"' || p_name || '\"}' WHEN 3 THEN p_name END", "t": "p_type", "b": "p_brand", "n": "p_name", "k": "p_size % 5"}, lambda v, t, b, n, k: sniff.response_label(v), "string", "CASE k WHEN 0 THEN t WHEN 1 THEN b WHEN 2 THEN n END")
part("secret_keys", {"v": "'{\"' || CASE p_size % 4 WHEN 0 THEN 'my_Token' WHEN 1 THEN 'password' WHEN 2 THEN 'note' ELSE 'a' END || '\":\"' || CASE WHEN p_size % 4 = 3 THEN 'session_id=' || p_type || '; b' ELSE p_name END || '\",\"n\":' || p_size || '}'", "k": "p_size % 4", "n": "p_name", "s": "p_size"}, lambda v, k, n, s: documents.redacted(v), "string", "CASE k WHEN 0 THEN '{\"my_Token\":\"[redacted]\",\"n\":' WHEN 1 THEN '{\"password\":\"[redacted]\",\"n\":' WHEN 2 THEN '{\"note\":\"' || n || '\",\"n\":' ELSE '{\"a\":\"session_id=[redacted]; b\",\"n\":' END || s || '}'")
part("pledge_signals", {"v": "'{\"data\":{\"relationships\":{' || CASE p_size % 5 WHEN 0 THEN '\"current_user_pledge\":{\"data\":{\"id\":\"' || p_partkey || '\"}}' WHEN 1 THEN '\"current_user_pledge\":{\"data\":null}' WHEN 2 THEN '\"current_user_pledge\":{\"data\":[{\"id\":\"1\"}]}' WHEN 3 THEN '\"current_user_pledge\":{}' ELSE '' END || '}}}'", "k": "p_size % 5"}, lambda v, k: feed.pledge_signal(v), "string", "CASE k WHEN 0 THEN 'present' WHEN 1 THEN 'explicit_none' WHEN 2 THEN 'present' ELSE 'missing' END")
part("include_lists", {"t": "CASE p_size % 4 WHEN 0 THEN 'A map of ' || p_name WHEN 1 THEN 'Set ' || p_size WHEN 2 THEN 'POLL: map?' WHEN 3 THEN p_type END", "k": "p_size % 4"}, lambda t, k: feed.access_label(t, F.lit(True), F.lit(1), F.lit(0), ["(?i)poll"], ["(?i)map", "^Set"]), "string", "CASE WHEN k < 2 THEN 'accessible' ELSE 'excluded' END")
rule("document_links", "pages", "page_id", {"v": "'{\"a\":{\"href\":\"' || url || '\"},\"b\":[{\"href\":\"/rel\"},{\"c\":{\"href\":\"http://y.example/' || page_id || '\"}}]}'", "u": "url", "i": "page_id"}, lambda v, u, i: F.array_join(web.document_hrefs(v), " "), "string", "u || ' http://y.example/' || i")
rule("tier_gates", "orders", "o_orderkey", {"p": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "f": "CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "c": "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN CAST(o_totalprice AS BIGINT) END"}, lambda p, f, c: feed.tier_gated(p, f, c), "boolean", "CASE WHEN f OR NOT p OR c > 0 THEN true WHEN p OR NOT f THEN false END", {"c": "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN CAST(bround(o_totalprice) AS BIGINT) END"})
rule("parsed_times", "orders", "o_orderkey", {"t": "CASE o_orderkey % 4 WHEN 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10) || 'T04:05:06Z' WHEN 1 THEN substring(CAST(o_orderdate AS STRING), 1, 10) || 'T04:05:06+02:00' WHEN 2 THEN o_orderpriority ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END", "d": "substring(CAST(o_orderdate AS STRING), 1, 10)", "k": "o_orderkey % 4"}, lambda t, d, k: F.date_format(dates.parsed(t), "yyyy-MM-dd HH:mm:ss"), "string", "CASE k WHEN 0 THEN d || ' 04:05:06' WHEN 1 THEN d || ' 02:05:06' WHEN 3 THEN d || ' 00:00:00' END")
rule("published_cutoffs", "orders", "o_orderkey", {"t": "o_orderdate", "d": "CASE o_orderkey % 3 WHEN 0 THEN '1998-03-05' WHEN 1 THEN 'soon' END", "k": "o_orderkey % 3"}, lambda t, d, k: posts.before_day(t.cast("timestamp"), "America/New_York", d), "boolean", "k = 0 AND t < TIMESTAMP '1998-03-05 05:00:00'")
