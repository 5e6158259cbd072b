"""Functions of one row on cases worked out by hand; queries run the same functions over columns of the tables."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import dates, guards, names, numbers, paths, posts, records, sniff, web
from foliant.operators import feed, library, parts, staging, tagging
from foliant.plans.case_queries import _kind, _lit
from foliant.sources import documents

CASES = {}


def cases(name, function, *rows):
    CASES[name] = (function, rows)


cases("name_extensions", posts.name_extension, ("a.ZIP", ".zip"), ("dir.x/b", ""), (".hidden", ""), ("a.tar.gz", ".gz"), ("a.toolong12", ""), ("a.b_c", ""), (None, ""), ("x.7z", ".7z"))
cases("url_tails", posts.url_tail, ("https://h.example/a/b.png?x=1#y", "b.png"), ("https://h.example/a/", "a"), ("https://h.example", ""), ("/p/q", "q"), ("", ""), ("https://h.example/?q=/z", ""))
cases("mime_extensions", posts.mime_extension, ("image/JPEG; q=1", ".jpg"), ("application/zip", ".zip"), ("text/html", ""), (None, ""), (" video/quicktime ", ".mov"))
cases(
    "ensured_extensions", posts.with_extension, ("map", "https://h.example/f/1.pdf", "", "map.pdf"), ("map.zip", "https://h.example/f/1.pdf", "", "map.zip"), ("", "https://h.example/f/1.pdf", "", "1.pdf"),
    ("map", "https://h.example/f", "image/png", "map.png"), (None, None, None, "file"), (" song ", "https://h.example/x", "audio/mpeg", "song.mp3"), ("v1.2 notes", "https://h.example/x", "", "v1.2 notes"),
)
cases("image_looks", posts.looks_like_image, ("a.png", "", "", True), ("a", "image/x", "", True), ("a.zip", "", "https://h.example/a.JPG", True), ("a.zip", "application/zip", "", False), (None, None, None, False))
cases("downloadables", posts.downloadable, ("a.zip", "", "https://h.example/1", True), ("a.png", "", "https://h.example/1", False), ("a", "application/pdf", "https://h.example/1", True), ("a.exe", "", "https://h.example/1", False), ("a.zip", "", "", False), ("a", "", "https://h.example/s.mp3", True))
cases("creator_names", posts.creator_of, ("https://h.example/c/artist/posts", "artist"), ("https://h.example/artist", "artist"), ("https://h.example/user/x/about?y", "x"), ("https://h.example/", ""), ("https://h.example/posts", ""), ("https://h.example/cw/a/b", "b"))
cases("folder_slugs", posts.folder_safe, ("artist-1", True), ("CON", False), ("a/b", False), ("x.", False), ("", False), (None, False), ("a b", True), (".x", False))
cases(
    "post_folders", posts.post_folder, ("12", "A map: day", "12_A map_ day"), ("12", None, "12_12"), ("12", "...", "12_12"), ("7", "x" * 95, "7_" + "x" * 80), ("1" * 39, "y" * 49 + ". z", "1" * 39 + "_" + "y" * 49),
)
cases(
    "summary_lines", posts.summary_line, ("a", 0, 0, 0, 0, 0, "a: 0 posts in window"), ("b", 0, 3, 0, 0, 3, "b: 0 accessible posts in window (3 listed, 3 locked for your tier)"), ("c", 1, 2, 3, 4, 10, "c: 1 accessible, 2 locked, 3 excluded, 4 deferred (10 listed)"),
)
cases("size_caps", posts.too_big, (1048577, 1, True), (1048576, 1, False), (None, 1, False), (5, None, False))
cases("kinds_or_other", posts.kind_or_other, ("zip", "zip"), ("image", "other"), (None, "other"), ("loose-media", "loose-media"))
cases("statuses_or_failed", posts.status_or_failed, ("planned", "planned"), ("done", "failed"), (None, "failed"), ("deferred", "deferred"))
cases("content_names", posts.content_name, ("a.zip", "0123456789abcdef0123", False, False, "a.zip"), ("a.zip", "0123456789abcdef0123", True, False, "a__01234567.zip"), ("a.zip", "0123456789abcdef0123", True, True, "a__0123456789abcdef.zip"), ("n", "ff00ff00ff", True, False, "n__ff00ff00"))
cases("redacted_texts", posts.without_secret, ("key abc and abc", "abc", "key <redacted> and <redacted>"), ("x", "", "x"), ("x", None, "x"), (None, "a", None))
cases("log_snippets", posts.snippet, ("a\r\nb", "a  b"), ("y" * 300, "y" * 200), (None, ""))
cases("log_addresses", web.loggable, ("https://h.example/a?b=c#d", "https://h.example/a"), ("x?y", "x"), ("", ""))
cases("model_fields", records.model_field, ("disabled", "x", "disabled"), ("ok", "maps", "ok=maps"), ("ok", None, "ok:not-called"), ("unavailable", None, "unavailable"), ("ok", "", "ok:not-called"))
cases("sidecar_subjects", lambda b, s, c: records.sidecar(b, s, c)["subjects"], ("_Maps", "city", "high", ["_Maps", "city"]), ("_Maps", "", "low", ["_Maps"]), ("_Docs", None, "unsure", ["_Docs"]))
cases("sidecar_ratings", lambda b, s, c: records.sidecar(b, s, c)["rating"], ("_Maps", "city", "high", 5), ("_Maps", "", "low", 2), ("_Docs", None, "unsure", 0), ("_Docs", None, "other", 0))
cases("standin_sizes", records.standin_megabytes, (104857600, 1000, 1000, 500, 500, "25.000"), (1048576, 100, 100, 100, 100, "1.000"), (10, 0, 0, 0, 0, "0.000"))
cases("proxy_suffixes", records.proxy_suffix, ("a.PNG", ".png"), ("a.tiff", ".jpg"), ("a.jpeg", ".jpeg"), ("a", ".jpg"))
cases("action_texts", records.action_text, (3, True, "recreate 3 parts + overview + zip"), (0, True, "overview + zip"), (0, False, "stand-in only"))
cases("source_names", records.source_name, ("/srv/art", "art"), ("C:/", "C"), ("/", "root"), ("D:\\\\maps\\\\", "maps"), ("/a/b:c", "b_c"))
cases("expected_places", lambda rel, role: records.expected_place("/t", rel, role), ("a/b c.png", "file", "/t/a/b c.png"), ("a/b c.png", "original-zip", "/t/_Originals_Zipped/a/b_c.zip"), ("x.png", "original-zip", "/t/_Originals_Zipped/x.zip"))
cases("backup_names", records.backup_name, ("a.txt", "ff", ["x"], "a.txt.ff.bak"), ("a.txt", "ff", ["a.txt.ff.bak"], "a.txt.ff.2.bak"), ("a.txt", "ff", ["a.txt.ff.bak", "a.txt.ff.2.bak"], "a.txt.ff.3.bak"))
cases("glob_excludes", lambda rel: guards.excluded_by(rel, ["*.tmp", "cache", "docs/*.md", "?.log"]), ("a/b.tmp", "*.tmp"), ("x/cache/y.txt", "cache"), ("docs/a.md", "docs/*.md"), ("z/docs/a.md", None), ("logs/a.log", "?.log"), ("ok.txt", None), ("cached", None))
cases("member_escapes", guards.escapes, ("a/b", ["x"], False), ("../a", ["x"], True), ("a/../b", ["x"], False), ("a/../../b", ["x"], True), ("l/b", ["l"], True), ("/etc", ["x"], True), ("a/l/b", ["l"], False))
cases("absolute_paths", guards.is_absolute, ("/a", True), ("C:\\x", True), ("c:x", False), ("\\\\srv\\x", True), ("a/b", False), (None, False))
cases("archive_formats", guards.archive_format, ("a.ZIP", None, "zip"), ("a.tgz", "", "tar.gz"), ("a.tar.gz", None, "tar.gz"), ("a.7z", None, None), ("a.7z", "zip", "zip"), ("a.zip", "rar", None))
cases("safe_segments", guards.safe_segment, ("ok", True), ("..", False), ("a/b", False), ("a.", False), ("", False), (None, False), ("a b", True), ("x?", False))
cases("subbin_names", guards.subbin_name, ("city", True), (" city", False), (".git", False), ("a:b", False), ("", False), (None, False), ("two words", True))
cases("model_addresses", guards.local_model, ("http://localhost:11434/api", True), ("https://127.0.0.1", True), ("http://[::1]:8/x", True), ("http://h.example", False), ("ftp://localhost", False), (None, False))
cases("model_names", lambda n: guards.model_name(n, ("blocked",)), ("small:7b", True), ("", False), ("is-Blocked-8", False), ("a\nb", False), (None, False))
cases("write_guards", lambda d: guards.may_write(d, ["/library", "/quarantine"], ["/library/keep"]), ("/library/a", True), ("/library/keep/a", False), ("/librarian/a", False), ("/quarantine/x", True), ("/x", False))
cases("staging_refusals", lambda p: guards.staging_refusal(p, "/library", "/ex"), ("/w/.GIT/x", "under .git"), ("/library/in", "inside the library"), ("/ex/a", "among the examples"), ("/w/in", None))
cases(
    "scan_arguments", guards.scan_argument_error, (1.0, 1.0, 100, 80, 0.9, "_p", None), (-1.0, 1.0, 100, 80, 0.9, "_p", "thresholds"), (1.0, 1.0, 0, 80, 0.9, "_p", "max_dim"), (1.0, 1.0, 9, 101, 0.9, "_p", "quality"),
    (1.0, 1.0, 9, 80, 0.9, "a/b", "suffix"), (1.0, 1.0, 9, 80, 1.5, "_p", "min_score"),
)
cases(
    "session_errors", guards.session_error, ("challenge", 200, 200, "x", False, "challenge"), (None, 401, 200, "x", False, "auth"), (None, 429, 200, "x", False, "rate"), (None, 302, 200, "x", False, "auth"),
    (None, 200, None, "", True, "auth"), (None, 200, None, "me", True, None), (None, 204, 204, None, False, None),
)
cases("site_gates", guards.site_error, (True, True, None), (True, False, "site is disabled"), (False, True, "unknown site"), (None, None, "unknown site"))
cases("done_filter", guards.outputs_present, ("done", True, False, None, None, None, True), ("done", True, True, True, True, True, True), ("done", True, True, True, False, True, False), ("new", True, False, None, None, None, False), ("done", None, False, None, None, None, False))
cases("scannable_images", lambda n: guards.scannable(n, (".png", ".jpg"), "_proxy"), ("a.PNG", True), ("a_proxy.png", False), ("a.txt", False), ("b.jpg", True))
cases("marker_indexes", numbers.marker_index, ("a", 0), ("C", 2), ("12", 12), ("ab", -1), ("", -1))
cases("refine_slops", numbers.refine_slop, (320, 200, 8), (3200, 100, 12), (6400, 9000, 31))
cases("backoffs", numbers.backoff, (1, None, 1.0), (4, None, 8.0), (2, 30, 30.0), (20, None, 120.0), (1, 500, 120.0), (3, -1, 4.0))
cases("finite_values", numbers.finite, (1.5, 1.5), (float("inf"), 0.0), (-2.0, -2.0))
cases("retry_headers", numbers.retry_after, ("12", 12), (" 7 ", 7), ("soon", None), (None, None), ("-1", None))
cases("rounded_megabytes", numbers.megabytes, (1048576, 1.0), (1500000, 1.431), (0, 0.0))
cases("rounded_megapixels", numbers.megapixels, (1000000, 1.0), (89478485, 89.478))
cases("sanitized_names", paths.sanitized, ("a:b", "a_b"), ("CON", "_CON"), ("con.txt", "_con.txt"), ("x. ", "x"), ("...", "item"), ("fine", "fine"))
cases("suffixes", lambda n: paths.suffix(n), ("a.b.C", ".C"), (".hid", ""), ("a.", ""), ("plain", ""), ("x.tar.gz", ".gz"))
cases("set_folders", lambda p: paths.set_directory(p, 2), ("a/b/c/d.png", "a/b"), ("a/x.png", "a"), ("x.png", ""))
cases("temporary_names", names.temporary_target, ("a.zip.partial", "a.zip"), ("a.zip.part1", "a.zip"), ("a.part1.rar", None), ("a.zip.bad2", "a.zip"), ("a.zip", None))
cases("combined_names", parts.says_combined, ("x/Combined High/a.png", True), ("x/a_combined.png", True), ("x/a.png", False))
cases("zip_policies", lambda c, f: F.concat(*[parts.should_zip(m, c, f).cast("string") for m in ("none", "all", "combined", "combined-with-parts")]), (True, "yes", "falsetruetruetrue"), (True, "no", "falsetruetruefalse"), (False, "yes", "falsetruefalsefalse"))
cases("fitted_sizes", lambda w, h: F.concat_ws("x", parts.fit_within(w, h, 1000)["width"], parts.fit_within(w, h, 1000)["height"]), (4000, 2000, "1000x500"), (500, 200, "500x200"), (1000000, 1, "1000x1"))
cases("media_kinds", lambda n, s, m: web.media_kind(n, s, m), ("a.zip", "attachment", None, "zip"), ("a", "attachment", "application/zip; x", "zip"), ("a.png", "attachment", None, "loose-media"), ("a", "image", None, "loose-media"), ("a.pdf", "attachment", "application/pdf", "other"))
cases(
    "single_places", lambda e, cur, st, ex, new, dry: staging.single_status(e, cur, st, ex, new, dry), (True, "aa", "bb", "AA", False, False, "placed"), (True, "aa", "bb", "cc", False, False, "stale"), (True, "aa", "aa", "cc", False, False, "unchanged"),
    (False, None, "bb", "aa", False, False, "missing"), (True, "aa", "bb", None, True, False, "exists"), (False, None, "bb", None, True, True, "would-place"), (False, None, "bb", None, True, False, "placed"),
)
cases("tag_eligibility", lambda b, c, p: tagging.eligible(b, c, p)["reason"], ("_Maps", "high", "/a/.git/x", "refused: path under .git"), ("_Maps", "low", "/a/x", "not high confidence"), ("nowhere", "high", "/a/x", "unknown bin"), ("_Maps", "high", "/a/x", ""))
cases("area_percents", numbers.area_percent, (1, 8, 12), (3, 8, 38), (5, 200, 2), (1, 0, 0))
cases("git_paths", lambda p: paths.in_folder_named(p, ".git"), ("/a/.GIT/b", True), ("/a/x.git/b", False), ("/.git", True))
cases("published_cutoffs", lambda at, day: posts.before_day(at.cast("timestamp"), "America/New_York", day), ("2024-03-05 04:59:59Z", "2024-03-05", True), ("2024-03-05 05:00:00Z", "2024-03-05", False), (None, "2024-03-05", False), ("2020-01-01 00:00:00Z", None, False), ("2020-01-01 00:00:00Z", "soon", False))
cases("family_keys", records.family_key, (["a", "b", "c"], ["a", "b"]), (["a"], ["a"]), (["x", "y"], ["x"]))
cases("parsed_times", lambda t: F.date_format(dates.parsed(t), "yyyy-MM-dd HH:mm:ss"), ("2024-03-05T04:05:06Z", "2024-03-05 04:05:06"), ("2024-03-05T04:05:06+02:00", "2024-03-05 02:05:06"), ("not-a-date", None), ("", None), (None, None), ("2024-03-05", "2024-03-05 00:00:00"))
cases("part_token_lists", names.part_tokens, ("Map_A Day_HD", ["map", "aday"]), ("King's_Hall__grid", ["kings", "hall"]), ("x", ["x"]))
cases("part_markers", names.marker, ("a", "a"), ("12", None), ("pt12", "12"), ("7", "7"), ("ptx", None), ("ab", None))
cases("retargeted_paths", lambda p: library.retargeted(p, "f", "m"), ("Sets_F/Map_F_Day.png", "Sets_M/Map_M_Day.png"), ("x/map_f.png", "x/map_m.png"), ("x/map_ptf.png", "x/map_ptm.png"), ("x/off.png", "x/off.png"))
cases("member_reasons", paths.archive_member_reason, ("a/b", None), ("", "empty"), ("/a", "absolute"), ("c:/x", "drive"), ("a/../b", "traversal"), ("a?b", "illegal"), ("a\\..\\b", "traversal"))
cases("canonical_members", paths.canonical_member, ("a//b/./c", "a/b/c"), ("./x", "x"), ("a\\b", "a/b"))
cases("archive_file_names", lambda n: paths.zip_archive_name(n, (".png", ".jpg")), ("A map.png", "A_map.zip"), ("a  b_.jpg", "a_b.zip"), ("x.tif", "x.tif.zip"))
cases("document_links", web.document_hrefs, ('{"a":{"href":"https://x.example/1"},"b":[{"href":"/rel"},{"href":"http://y.example"}]}', ["https://x.example/1", "http://y.example"]), ("{}", []))
cases("response_labels", sniff.response_label, ('{"message":{"content":"{\\"bin\\": \\"_Maps\\"}"}}', "_Maps"), ('{"bin":"_Docs"}', "_Docs"), ('{"message":{"content":" _Images "}}', "_Images"), ('{"message":{"content":"{\\"label\\":\\"x\\"}"}}', "x"), ("no json", None), (None, None))
cases("secret_keys", documents.redacted, ('{"token":"abc","n":1}', '{"token":"[redacted]","n":1}'), ('{"a":"session_id=q; b=c"}', '{"a":"session_id=[redacted]; b=c"}'), ('{"my_password":"x"}', '{"my_password":"[redacted]"}'))
cases("pledge_signals", feed.pledge_signal, ('{"data":{"relationships":{"current_user_pledge":{"data":{"id":"1"}}}}}', "present"), ('{"data":{"relationships":{"current_user_pledge":{"data":null}}}}', "explicit_none"), ('{"data":{"relationships":{}}}', "missing"), ('{"data":{"relationships":{"current_user_pledge":{"data":[{"id":"2"}]}}}}', "present"), ('{"data":{"relationships":{"current_user_pledge":{}}}}', "missing"), ("{}", "missing"))
cases("tier_gates", lambda p, f, c: feed.tier_gated(p, f, c), (True, False, 0, False), (False, None, None, True), (None, True, None, True), (None, None, 500, True), (None, None, None, None), (None, False, 0, False))
cases("include_lists", lambda t: feed.access_label(t, F.lit(True), F.lit(1), F.lit(0), ["(?i)poll"], ["(?i)map", "^Set"]), ("A map", "accessible"), ("Set 3", "accessible"), ("Poll: map?", "excluded"), ("News", "excluded"), (None, "excluded"))


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    function, rows = CASES[name]
    kinds = [_kind(column) for column in zip(*(r[:-1] for r in rows))]
    given = [function(*[_lit(v, k) for v, k in zip(r[:-1], kinds)]).cast(_kind([r[-1] for r in rows])).alias(f"c{n}") for n, r in enumerate(rows)]
    got = spark.range(1).select(*given).first()
    assert list(got) == [r[-1] for r in rows]


def test_backup_names_are_free_up_to_the_last(spark):
    """Numbers go on to 999, and nulls among the held names hide nothing."""
    taken = lambda last: ["a.ff.bak", *[f"a.ff.{k}.bak" for k in range(2, last + 1)]]
    rows = [(taken(998), "a.ff.999.bak"), (taken(999), None), (["a.ff.bak", None], "a.ff.2.bak"), ([], "a.ff.bak"), (["a.ff.2.bak", "a.ff.bak", "x"], "a.ff.3.bak"), (None, None)]
    frame = spark.createDataFrame(rows, "held array<string>, want string")
    name = records.backup_name(F.lit("a"), F.lit("ff"), F.col("held"))
    assert [(r.got, r.want) for r in frame.select(name.alias("got"), "want").collect() if r.got != r.want] == []
