"""Posts of paged feeds: flattening, windows, labels, media."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths, posts, web
from ..functions.sniff import first_of

# Relationships that hold files, and the type of a page.
FILE_RELATIONSHIPS = ("attachments", "attachments_media", "audio")
REFERENCE = "array<struct<id:string,type:string>>"
PAGE = (
    "struct<data:array<struct<id:string,type:string,attributes:struct<title:string,url:string,published_at:string,current_user_can_view:boolean,content:string,"
    "content_json_string:string,is_public:boolean,is_paid:boolean,min_cents_pledged_to_view:bigint>,relationships:map<string,struct<data:" + REFERENCE + ">>>>,"
    "included:array<struct<id:string,type:string,attributes:struct<name:string,file_name:string,url:string,download_url:string,mimetype:string,size:bigint,size_bytes:bigint,"
    "image_urls:struct<original:string,default:string>>>>,links:struct<next:string>>"
)


def posts_of(pages: DataFrame, json: str = "payload") -> DataFrame:
    """page, pos and the fields of every post of JSON:API pages (page, payload)."""
    own = pages.select("page", F.from_json(json, PAGE).alias("p"))
    return own.select("page", F.posexplode("p.data").alias("pos", "d")).select(
        "page", "pos", F.col("d.id").alias("post_id"), F.col("d.attributes.title").alias("title"), F.col("d.attributes.url").alias("url"),
        F.try_to_timestamp("d.attributes.published_at").alias("published"), F.coalesce("d.attributes.current_user_can_view", F.lit(False)).alias("can_view"),
        F.concat(web.hrefs(F.coalesce("d.attributes.content", F.lit(""))), web.document_hrefs(F.coalesce("d.attributes.content_json_string", F.lit("")))).alias("hrefs"),
        tier_gated(F.col("d.attributes.is_public"), F.col("d.attributes.is_paid"), F.col("d.attributes.min_cents_pledged_to_view")).alias("gated"),
    )


def media_of(pages: DataFrame, json: str = "payload") -> DataFrame:
    """post_id, media_id, name, url, kind, size of every file a post refers to; the first of equal addresses counts.

    References find included resources by type and id; where no resource has both, by id alone.  A page is one row that
    holds both sides, so they meet in that row and only the files found are shuffled.
    """
    own = pages.select(F.from_json(json, PAGE).alias("p"))
    refs = (
        own.select(F.col("p.included").alias("inc"), F.explode("p.data").alias("d")).select("inc", F.col("d.id").alias("post_id"), F.explode("d.relationships").alias("rel", "r"))
        .select("inc", "post_id", "rel", F.posexplode("r.data").alias("pos", "ref")).filter(F.col("rel").isin(*FILE_RELATIONSHIPS, "images", "media"))
    )
    first = lambda test: F.get(F.filter("inc", test), F.lit(0))["attributes"]
    typed = first(lambda i: (i["id"] == F.col("ref.id")) & (i["type"] == F.col("ref.type")))
    joined = refs.withColumn("a", F.coalesce(typed, first(lambda i: i["id"] == F.col("ref.id")))).drop("inc").filter("a IS NOT NULL")
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(f"a.{n}"), F.lit("")) for n in names], F.lit(""))
    made = joined.select(
        "post_id", "rel", "pos", F.col("ref.id").alias("media_id"), filled("name", "file_name").alias("name"),
        filled("url", "download_url", "image_urls.original", "image_urls.default").alias("url"),
        web.media_kind(filled("name", "file_name"), F.when(F.col("rel") == "images", "image").otherwise("attachment"), F.col("a.mimetype")).alias("kind"), F.coalesce("a.size", "a.size_bytes").alias("size"),
    ).filter("url <> ''")
    return made.groupBy("post_id", "url").agg(F.min_by(F.struct("media_id", "name", "kind", "size"), F.struct("rel", "pos")).alias("m")).select("post_id", "m.media_id", "m.name", "url", "m.kind", "m.size")


def tier_gated(public: Column, paid: Column, cents: Column, tiers: Column | None = None) -> Column:
    """true: for members; false: open; null: the page does not say."""
    closed = F.coalesce(paid, F.lit(False)) | ~F.coalesce(public, F.lit(True)) | (F.coalesce(cents, F.lit(0)) > 0)
    if tiers is not None:
        closed = closed | (F.size(tiers) > 0)
    return F.when(closed, True).when(F.coalesce(public, F.lit(False)) | ~F.coalesce(paid, F.lit(True)), False)


def access_label(title: Column, can_view: Column, media: Column, links: Column, exclude: list[str], include: list[str] | None = None) -> Column:
    """excluded, locked, deferred (outside link) or accessible; the excluding pattern's own label wins if it has one."""
    title = F.coalesce(title, F.lit(""))
    hit = first_of([(title.rlike(p), F.lit(p)) for p in exclude], F.lit(None)) if exclude else F.lit(None).cast("string")
    missed = ~reduce(lambda a, b: a | b, [title.rlike(p) for p in include]) if include else F.lit(False)
    return (
        F.when(F.lower(hit).contains("chronos"), "excluded (chronos)").when(hit.isNotNull() | missed, "excluded")
        .when(~can_view, "locked").when((media == 0) & (links > 0), "deferred (outside link)").otherwise("accessible")
    )


def take_while(posts: DataFrame, *order: str, key: str, published: str, since, until, most: int | None = None) -> DataFrame:
    """Posts of a newest-first feed: later ones than ``until`` are passed over, the first one before ``since`` ends the
    feed, and at most ``most`` of the rest are taken."""
    at = F.struct(*order)
    # the end of a feed is a minimum: no window has to hold a crowded feed's rows
    ends = posts.filter(F.col(published) < since).groupBy(key).agg(F.min(at).alias("_end"))
    alive = posts.join(ends, key, "left").filter(F.coalesce(at < F.col("_end"), F.lit(True)) & F.coalesce(F.col(published) < until, F.lit(True))).drop("_end")
    if most is None:
        return alive
    return alive.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def label_counts(posts: DataFrame, label: str = "label") -> DataFrame:
    """One row: listed and the number of each class of labels."""
    kinds = ("accessible", "locked", "excluded", "deferred")
    return posts.agg(F.count("*").alias("listed"), *[F.count_if(F.col(label).startswith(k)).alias(k) for k in kinds])


def post_status(files: DataFrame, key: str = "post_id") -> DataFrame:
    """key, status: failed before downloaded before planned before all duplicates before deferred."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return files.groupBy(key).agg(
        F.when(has("failed"), "failed").when(has("downloaded"), "downloaded").when(has("planned"), "planned")
        .when(F.bool_and(F.col("status") == "skipped-duplicate"), "skipped-duplicate").when(has("deferred"), "deferred").otherwise("skipped").alias("status")
    )


def against_index(files: DataFrame, known_media: DataFrame, known_sha: DataFrame) -> DataFrame:
    """files (order, media_id, sha256) with outcome: a known media id, known bytes, or bytes seen earlier in this run
    are ``skipped-duplicate``; the rest is ``downloaded``."""
    first = files.groupBy("sha256").agg(F.min("order").alias("_first"))
    marked = (
        files.join(known_media.select("media_id", F.lit(True).alias("_m")).distinct(), "media_id", "left").join(known_sha.select("sha256", F.lit(True).alias("_s")).distinct(), "sha256", "left").join(first, "sha256", "left")
    )
    dup = F.col("_m").isNotNull() | F.col("_s").isNotNull() | F.coalesce(F.col("order") > F.col("_first"), F.lit(False))
    return marked.withColumn("outcome", F.when(dup, "skipped-duplicate").otherwise("downloaded")).drop("_m", "_s", "_first")


def outside_links(posts: DataFrame, own_domains: list[str]) -> DataFrame:
    """post_id, n, host, url: links to other hosts, each address once in the order of first sight."""
    spread = posts.select("post_id", F.posexplode("hrefs").alias("pos", "url")).groupBy("post_id", "url").agg(F.min("pos").alias("n"))
    spread = spread.withColumn("host", web.host(F.col("url"))).filter("host IS NOT NULL AND host <> ''")
    for d in own_domains:
        spread = spread.filter(~web.under_domain(F.col("host"), F.lit(d)))
    return spread.select("post_id", "n", "host", "url")


def membership(posts: DataFrame) -> DataFrame:
    """key, member: any viewable gated post says yes; else any viewable one of unknown kind says unknown (null); else no."""
    seen = F.col("can_view")
    return posts.groupBy("key").agg(F.when(F.bool_or(seen & F.coalesce("gated", F.lit(False))), True).when(F.bool_or(seen & F.col("gated").isNull()), F.lit(None)).otherwise(False).alias("member"))


# File relationships beside the attachments, and who counts as a patron.
TIER_RELATIONSHIPS = ("access_rules", "rewards", "reward", "tiers")
MEMBER_TYPES, MEMBER_RELATIONSHIPS, ACTIVE = ("pledge", "member"), ("memberships", "pledges"), "active_patron"
SKIPPED = ("skipped-duplicate", "excluded", "locked", "deferred")
INCLUDED = (
    "array<struct<id:string,type:string,attributes:struct<campaign_id:string,patron_status:string,currently_entitled_amount_cents:string,amount_cents:string>,"
    "relationships:map<string,struct<data:" + REFERENCE + ">>>>"
)
ACCOUNT = "struct<data:struct<id:string,attributes:struct<current_user_is_free_member:boolean,vanity:string,name:string>,relationships:map<string,struct<data:" + REFERENCE + ">>>,included:" + INCLUDED + ">"


def paged(pages: DataFrame, most: int = 40) -> DataFrame:
    """The pages (page, payload, cursor, next) that a reader reaches: from the one without a cursor on by ``next``, at most ``most`` of a feed.

    A feed's pages are few, and each step is one join; a cursor that was read is not read again.
    """
    keys = ["feed"] if "feed" in pages.columns else []
    own = pages if keys else pages.withColumn("feed", F.lit(""))
    links = own.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("cursor", F.lit("")).alias("k"), F.coalesce("next", F.lit("")).alias("v")))).alias("links"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.array(F.lit("")),
        lambda seen, _: F.when(
            F.coalesce(F.element_at("links", F.element_at(seen, -1)), F.lit("")).isin("") | F.array_contains(seen, F.element_at("links", F.element_at(seen, -1))), seen
        ).otherwise(F.array_append(seen, F.element_at("links", F.element_at(seen, -1)))),
    )
    reached = links.select("feed", F.posexplode(F.slice(walk, 1, most)).alias("number", "cursor"))
    return own.withColumn("cursor", F.coalesce("cursor", F.lit(""))).join(reached, ["feed", "cursor"]).drop("cursor", *([] if keys else ["feed"]))


def content_files(hrefs: DataFrame, hosts: list[str]) -> DataFrame:
    """post_id, media_id, name, url, kind: links (post_id, pos, url) to files of known types on the given hosts, each address once, numbered in order."""
    name = posts.with_extension(posts.url_tail(F.col("url")), F.col("url"), F.lit(""))
    ours = F.lit(False)
    for h in hosts:
        ours = ours | web.under_domain(web.host(F.col("url")), F.lit(h))
    once = hrefs.filter(ours).groupBy("post_id", "url").agg(F.min("pos").alias("pos")).withColumn("name", name)
    files = once.filter(~posts.looks_like_image(F.col("name"), F.lit(""), F.col("url")) & posts.name_extension(F.col("name")).isin(*posts.FILE_TYPES))
    number = F.row_number().over(W.partitionBy("post_id").orderBy("pos"))
    return files.select("post_id", F.concat_ws("-", F.lit("content"), F.col("post_id").cast("string"), number.cast("string")).alias("media_id"), "name", "url", web.media_kind(F.col("name"), F.lit("attachment"), F.lit("")).alias("kind"))


def post_file(pages: DataFrame, json: str = "payload") -> DataFrame:
    """post_id, media_id, name, url, kind of each post's own file: no image, with an address."""
    shape = "struct<data:array<struct<id:string,attributes:struct<post_file:struct<name:string,url:string,mimetype:string>>>>>"
    own = pages.select(F.explode(F.from_json(json, shape)["data"]).alias("d")).select(F.col("d.id").alias("post_id"), "d.attributes.post_file.*")
    found = own.filter((F.coalesce("url", F.lit("")) != "") & ~posts.looks_like_image(F.col("name"), F.col("mimetype"), F.col("url")))
    name = posts.with_extension(F.col("name"), F.col("url"), F.col("mimetype"))
    return found.select("post_id", F.concat(F.lit("post-file-"), F.col("post_id")).alias("media_id"), name.alias("name"), "url", web.media_kind(name, F.lit("attachment"), F.col("mimetype")).alias("kind"))


def hosts_in_order(links: DataFrame) -> DataFrame:
    """post_id, hosts: the hosts of links (post_id, n, host), each once, in the order they are first seen."""
    first = links.groupBy("post_id", "host").agg(F.min("n").alias("n"))
    return first.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "host"))), lambda x: x["host"]).alias("hosts"))


def outside_rows(links: DataFrame) -> DataFrame:
    """File rows of links that stay outside: deferred, named by the address's tail."""
    name = F.coalesce(F.nullif(F.regexp_extract(F.rtrim("url", F.lit("/")), "([^/]*)$", 1), F.lit("")), F.lit("link"))
    return links.select("post_id", paths.sanitized(name, "link", 60).alias("name"), F.lit("other").alias("kind"), F.lit("deferred").alias("status"), "url", "host")


def selected_media(media: DataFrame, types: list[str]) -> DataFrame:
    """Media (with source_kind) of the chosen types, with their ``rank`` within a post: attachments (0) before images (1), then by pos."""
    kind = F.when(F.col("source_kind") == "image", "image").otherwise("attachment")
    return media.filter(kind.isin(*types)).withColumn("rank", F.when(kind == "image", 1).otherwise(0))


def post_tally(found: DataFrame, key: str) -> DataFrame:
    """key, ok, skipped, failed of posts by status."""
    s = F.col("status")
    return found.groupBy(key).agg(F.count_if(~s.isin(*SKIPPED, "failed")).alias("ok"), F.count_if(s.isin(*SKIPPED)).alias("skipped"), F.count_if(s == "failed").alias("failed"))


def list_tally(labelled: DataFrame, key: str, skipped: DataFrame) -> DataFrame:
    """One row: accessible posts are ok, others skipped, and a creator that was passed over (``skipped``: key) counts as one skip."""
    away = skipped.select(key).distinct().withColumn("_away", F.lit(True))
    own = labelled.join(away, key, "left").withColumn("_away", F.coalesce("_away", F.lit(False)))
    here = ~F.col("_away")
    return own.agg(F.count_if(here & (F.col("label") == "accessible")).alias("ok"), (F.count_if(here & (F.col("label") != "accessible")) + F.count_distinct(F.when(F.col("_away"), F.col(key)))).alias("skipped"), F.lit(0).cast("bigint").alias("failed"))


def ready_summary(files: DataFrame, key: str, verb: str = "would stage") -> DataFrame:
    """key, posts, files, zips, images, others, mb and text of the files (key, post_id, kind, size, status) that are or would be downloaded."""
    use = F.col("status").isin("downloaded", "planned")
    counts = files.groupBy(key).agg(
        F.count_distinct("post_id").alias("posts"), F.count_if(use).alias("files"), F.count_if(use & (F.col("kind") == "zip")).alias("zips"), F.count_if(use & (F.col("kind") == "loose-media")).alias("images"),
        F.bround(F.coalesce(F.sum(F.when(use, F.col("size"))), F.lit(0)) / (1024.0 * 1024.0)).cast("bigint").alias("mb"),
    ).withColumn("others", F.col("files") - F.col("zips") - F.col("images"))
    kinds = F.concat_ws(", ", F.format_string("%d zip", "zips"), F.when(F.col("images") > 0, F.format_string("%d image", "images")), F.when(F.col("others") > 0, F.format_string("%d other", "others")))
    return counts.withColumn("text", F.concat(F.col(key).cast("string"), F.format_string(": %d posts, %d files (%s), %d MB ", F.col("posts"), F.col("files"), kinds, F.col("mb")), F.lit(verb)))


def csv_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """post_id, n, line: a quoted line for each file of each post (post_id, title, url, status), one with blank file cells for a post without files."""
    f = files.select("post_id", "n", F.col("name").alias("f_name"), F.col("status").alias("f_status"), "staging_path", "sha256", "size", "host")
    joined = found.join(f, "post_id", "left")
    cells = [F.col("post_id").cast("string"), F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit("'")), F.col("url"), F.col("status"), F.col("f_name"), F.col("f_status"), F.col("staging_path"), F.col("sha256"), F.col("size").cast("string"), F.col("host")]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in cells])
    return joined.select("post_id", F.coalesce("n", F.lit(0)).alias("n"), line.alias("line"))


def active_patron(attributes: Column) -> Column:
    """Whether a member's record says that something is paid: an amount, or the status."""
    amount = lambda name: F.coalesce(F.trim(attributes[name]).try_cast("bigint") > 0, F.lit(False))
    return amount("currently_entitled_amount_cents") | amount("amount_cents") | F.coalesce(attributes["patron_status"] == ACTIVE, F.lit(False))


def campaign_ids(resource: Column) -> Column:
    """Ids of a resource's campaigns: of its relationship, then of its attributes."""
    related = F.coalesce(F.transform(F.element_at(resource["relationships"], "campaign")["data"], lambda r: r["id"]), F.array().cast("array<string>"))
    return F.array_compact(F.concat(related, F.array(resource["attributes"]["campaign_id"])))


def pledge_signal(payload: Column) -> Column:
    """present, explicit_none or missing: whether the campaign's record names a pledge of the user's.  An explicit null differs from no word at all."""
    data = F.get_json_object(payload, "$.data.relationships.current_user_pledge.data.id")
    first = F.get_json_object(payload, "$.data.relationships.current_user_pledge.data[0].id")
    said = F.get_json_object(payload, "$.data.relationships.current_user_pledge").rlike(r'"data"\s*:')
    return F.when(F.coalesce(data, first).isNotNull(), "present").when(F.coalesce(said, F.lit(False)), "explicit_none").otherwise("missing")


def account_membership(accounts: DataFrame, campaign: str = "campaign_id", payload: str = "payload") -> DataFrame:
    """key, member of user records: true for an active membership of the campaign, false for an ended one or other campaigns alone, else null."""
    p = accounts.withColumn("_p", F.from_json(payload, ACCOUNT))
    refs = F.flatten(F.array(*[F.coalesce(F.element_at(F.col("_p.data.relationships"), r)["data"], F.array().cast(REFERENCE)) for r in MEMBER_RELATIONSHIPS]))
    mine = F.filter(F.coalesce(F.col("_p.included"), F.expr(f"CAST(array() AS {INCLUDED})")), lambda i: F.exists(refs, lambda r: (r["id"] == i["id"]) & (r["type"] == i["type"])))
    judged = F.transform(mine, lambda i: F.struct(F.array_contains(campaign_ids(i), F.col(campaign)).alias("here"), (F.size(campaign_ids(i)) > 0).alias("some"), active_patron(i["attributes"]).alias("active")))
    return p.withColumn("_m", judged).select(
        "key", F.when(F.exists("_m", lambda m: m["here"] & m["active"]), True).when(F.exists("_m", lambda m: m["some"]), False).alias("member")
    )


def campaign_membership(campaigns: DataFrame, payload: str = "payload") -> DataFrame:
    """key, member of campaign records: true for a pledge, a free membership or an included active one of this campaign; else null."""
    p = campaigns.withColumn("_p", F.from_json(payload, ACCOUNT))
    active = F.exists(F.col("_p.included"), lambda i: i["type"].isin(*MEMBER_TYPES) & F.array_contains(campaign_ids(i), F.col("_p.data.id")) & active_patron(i["attributes"]))
    yes = (pledge_signal(F.col(payload)) == "present") | F.coalesce(F.col("_p.data.attributes.current_user_is_free_member"), F.lit(False)) | F.coalesce(active, F.lit(False))
    return p.select("key", F.when(yes, True).alias("member"))


def split_sets(files: DataFrame, key: str) -> DataFrame:
    """key, base, parts: the volumes of each split file in order, two or more; a plain ``base.zip`` (any case) ends its .zNN set."""
    v = files.withColumn("_v", names.split_volume(F.col("name")))
    volumes = v.filter("_v IS NOT NULL").select(key, "_v.scheme", "_v.base", F.col("_v.index").alias("n"), "name")
    plain = v.filter(F.col("_v").isNull() & names.temporary_target(F.col("name")).isNull()).select(key, F.lower("name").alias("_low"), F.col("name").alias("_plain"))
    bases = volumes.filter("scheme = 'zip_z'").select(key, "scheme", "base").distinct()
    last = bases.join(plain, (bases[key] == plain[key]) & (F.lower("base") == F.col("_low"))).select(bases[key], "scheme", "base", F.lit(1 << 30).alias("n"), F.col("_plain").alias("name"))
    every = volumes.unionByName(last).distinct()
    sets = every.groupBy(key, "scheme", "base").agg(F.array_sort(F.collect_list(F.struct("n", F.lower("name").alias("l"), "name"))).alias("p")).filter("size(p) > 1")
    return sets.groupBy(key, "base").agg(F.min_by("p", "scheme").alias("p")).select(key, "base", F.transform("p", lambda x: x["name"]).alias("parts"))


def listed(found: DataFrame, media: DataFrame, links: DataFrame, *, exclude: list[str], include: list[str] | None = None) -> DataFrame:
    """The listing: posts (creator, post_id, title, url, published, can_view) with access, attachments, images and hosts."""
    count = media.groupBy("post_id").agg(F.count_if(F.col("source_kind") != "image").alias("attachments"), F.count_if(F.col("source_kind") == "image").alias("images"))
    own = found.join(count, "post_id", "left").join(hosts_in_order(links), "post_id", "left")
    own = own.withColumns({"attachments": F.coalesce("attachments", F.lit(0)), "images": F.coalesce("images", F.lit(0)), "hosts": F.coalesce("hosts", F.array().cast("array<string>"))})
    return own.withColumn("access", access_label(F.col("title"), F.col("can_view"), F.col("attachments") + F.col("images"), F.size("hosts"), exclude, include))


def synced(found: DataFrame, media: DataFrame, links: DataFrame, known_media: DataFrame, *, max_mb: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts (the listing's, with status) and file rows (creator, post_id, media_id, name, kind, size, status) of a dry sync.

    Files of accessible posts are planned, known or repeated ones skipped, those over the cap deferred; links of posts
    without files are deferred; a post has the status of its files, or of its access.
    """
    open_posts = found.filter("access LIKE 'accessible%'").select("creator", "post_id")
    mine = media.join(open_posts, "post_id").join(known_media.select("media_id", F.lit(True).alias("_known")).distinct(), "media_id", "left")
    first = mine.groupBy("media_id").agg(F.min(F.struct("post_id", "pos")).alias("_first"))
    big = posts.too_big(F.col("size"), F.lit(max_mb).cast("double"))
    state = F.when(F.col("_known").isNotNull() | (F.struct("post_id", "pos") != F.col("_first")), "skipped-duplicate").when(big, "deferred").otherwise("planned")
    files = mine.join(first, "media_id").select("creator", "post_id", "media_id", posts.with_extension(F.col("name"), F.col("url"), F.lit("")).alias("name"), posts.kind_or_other(F.col("kind")).alias("kind"), "size", state.alias("status"))
    away = outside_rows(links.join(found.filter("access LIKE 'deferred%'").select("creator", "post_id"), "post_id")).join(found.select("creator", "post_id"), "post_id")
    files = files.unionByName(away.select("creator", "post_id", F.lit(None).cast("string").alias("media_id"), "name", "kind", F.lit(None).cast("bigint").alias("size"), "status"))
    shut = F.when(F.col("access").startswith("excluded"), "excluded").when(F.col("access") == "locked", "locked").when(F.col("access").startswith("deferred"), "deferred").otherwise("skipped")
    own = found.join(post_status(files).withColumnRenamed("status", "_files"), "post_id", "left")
    return own.withColumn("status", F.when(F.col("access").startswith("accessible"), F.coalesce("_files", shut)).otherwise(shut)).drop("_files"), files
