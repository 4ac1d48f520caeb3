"""Access tables: sessions, tokens, rate limits, paths, and snapshot forms of their updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_S, PER_EMAIL, PER_IP, RENEW_S = 900, 10, 30, 86_400
HEX64 = "^[0-9a-f]{64}$"

#: Media types by extension.
MEDIA_TYPES = {
    "html": "text/html; charset=utf-8", "js": "application/javascript; charset=utf-8", "css": "text/css; charset=utf-8",
    "json": "application/json; charset=utf-8", "webmanifest": "application/manifest+json", "txt": "text/plain; charset=utf-8",
    "md": "text/plain; charset=utf-8", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml",
    "ico": "image/x-icon", "webp": "image/webp", "pdf": "application/pdf", "woff2": "font/woff2",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
FRESH = ("html", "json", "js", "webmanifest")
#: Fixed value: paths that are never served.
DENIED = r"(?i)(^|/)(\.|_srv(/|$)|auth(/|$))|\.(php|phtml|phar|sql|ini|log|sh|py)$"

#: Schemas of the tables (times are epoch seconds, 0 for never).
USERS = "id long, email string, name string, pass string, role string, status string, verified int, created long, last_login long"
SESSIONS = "id long, token string, user_id long, expires long, created long"
TOKENS = "id long, token string, user_id long, kind string, expires long"
ATTEMPTS = "id long, ip string, email string, at long"


def token_hash(token: Column) -> Column:
    """What the tables hold of a presented token; null for what is no token."""
    return F.when(F.rlike(token, F.lit(HEX64)), F.sha2(token, 256))


def valid_sessions(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Sessions that have not expired, of active and verified users, with the user's columns (prefix u_)."""
    u = users.filter("status = 'active' and verified = 1").select([F.col(c).alias(f"u_{c}") for c in users.columns])
    return sessions.filter(F.col("expires") >= now).join(u, F.col("user_id") == F.col("u_id"))


def session_users(presented: DataFrame, sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """presented (column token: as the visitor sent it) with the valid session it names and the user's columns."""
    live = valid_sessions(sessions, users, now).withColumnRenamed("token", "hashed")
    return presented.withColumn("hashed", token_hash(F.col("token"))).join(live, "hashed").drop("hashed")


def token_users(presented: DataFrame, tokens: DataFrame, kind: str, now: int) -> DataFrame:
    """(token, user_id) of presented tokens (column token) that are valid for this use."""
    live = valid_tokens(tokens, kind, now).select(F.col("token").alias("hashed"), "user_id")
    return presented.select("token", token_hash(F.col("token")).alias("hashed")).join(live, "hashed").select("token", "user_id")


def used(tokens: DataFrame, presented: DataFrame, kind: str, now: int) -> DataFrame:
    """tokens after the valid ones among the presented are used."""
    gone = token_users(presented, tokens, kind, now).select(token_hash(F.col("token")).alias("token"))
    return without(tokens, gone, "token")


def opened(sessions: DataFrame, logins: DataFrame, now: int, days: int = 90) -> DataFrame:
    """sessions after logins (id, token, user_id): expired ones are gone, the new ones hold the token's hash."""
    end = F.lit(now + days * 86_400).cast("long")
    new = logins.select("id", token_hash(F.col("token")).alias("token"), "user_id", end.alias("expires"), F.lit(now).cast("long").alias("created"))
    return sessions.filter(F.col("expires") >= now).unionByName(new)


def new_users(rows: DataFrame, how: str, now: int, open_registration: bool = False, verify: bool = True) -> DataFrame:
    """Users of rows (id, email, name, pass: hashed); how: first (the site's administrator), self or added."""
    role, status, verified = {
        "first": ("admin", "active", 1),
        "self": ("user", "active" if open_registration else "pending", 0 if verify else 1),
        "added": ("user", "active", 1),
    }[how]
    name = F.trim("name")
    return rows.select(
        "id", norm_email(F.col("email")).alias("email"), (F.left(name, F.lit(100)) if how == "added" else name).alias("name"), "pass", F.lit(role).alias("role"), F.lit(status).alias("status"),
        F.lit(verified).alias("verified"), F.lit(now).cast("long").alias("created"), F.lit(0).cast("long").alias("last_login"),
    )


def updated(users: DataFrame, acts: DataFrame) -> DataFrame:
    """users after acts (id, act, value), one for a user: rehash, verify, reset, approve, block, role (admin or user) or
    login (value: the time)."""
    a = acts.select(F.col("id").alias("_act_id"), F.col("act").alias("_act"), F.col("value").alias("_value"))
    is_ = lambda *names: F.coalesce(F.col("_act").isin(*names), F.lit(False))
    changes = {
        "pass": F.when(is_("rehash", "reset"), F.col("_value")),
        "role": F.when(is_("role"), F.col("_value")),
        "status": F.when(is_("approve"), "active").when(is_("block"), "blocked"),
        "verified": F.when(is_("verify", "reset", "approve"), 1),
        "last_login": F.when(is_("login"), F.col("_value").cast("long")),
    }
    rows = users.join(a, users["id"] == a["_act_id"], "left")
    return rows.select(*[F.coalesce(changes[c], F.col(c)).alias(c) if c in changes else users[c] for c in users.columns])


def closed_by(acts: DataFrame) -> DataFrame:
    """(user_id) whose sessions end: reset, blocked and deleted ones."""
    return acts.filter(F.col("act").isin("reset", "block", "delete")).select(F.col("id").alias("user_id")).distinct()


def deleted(users: DataFrame, sessions: DataFrame, tokens: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the users of gone (user_id) and what belongs to them."""
    return without(users, gone.select(F.col("user_id").alias("id")), "id"), without(sessions, gone, "user_id"), without(tokens, gone, "user_id")


def after_attempts(attempts: DataFrame, new: DataFrame, now: int, keep: int = 86_400) -> DataFrame:
    """attempts after new ones (id, ip, email, at); those over a day old are gone, addresses cut to the column's width."""
    new = new.select("id", F.left("ip", F.lit(45)).alias("ip"), "email", "at")
    return attempts.filter(F.col("at") >= now - keep).unionByName(new)


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.col("email") == email)


def active_admins(users: DataFrame) -> DataFrame:
    return users.filter("role = 'admin' and status = 'active'").select("email")


def renewed(sessions: DataFrame, now: int, days: int = 90) -> DataFrame:
    """Sessions with a new end, unless the old one is less than a day short of it."""
    end = F.lit(now + days * 86_400).cast("long")
    live = F.col("expires") >= now
    return sessions.withColumn("expires", F.when(live & (end - F.col("expires") > RENEW_S), end).otherwise(F.col("expires")))


def valid_tokens(tokens: DataFrame, kind: str, now: int) -> DataFrame:
    return tokens.filter((F.col("kind") == kind) & (F.col("expires") > now))


def issue_token(tokens: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Tokens after new ones: those they supersede (same user and kind) and expired ones are gone."""
    old = tokens.filter(F.col("expires") >= now).join(new.select("user_id", "kind").distinct(), ["user_id", "kind"], "left_anti").select(tokens.columns)
    return old.unionByName(new)


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """rows less those whose keys are in gone: DELETE as a snapshot."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(rows.columns)


#: Seconds of one slice of a key's time.
SLICE_S = 3600


def seconds_sliced(each: DataFrame, window: int, slice_s: int = SLICE_S) -> DataFrame:
    """each (_k, _t, _c: key, second, count) with the slice that its second stands in (_own) and a row for every slice whose
    windows reach it (_s): its own, and the next one if it stands at the end. A slice holds a row for each second at most,
    however many attempts."""
    own = F.floor(F.col("_t") / slice_s)
    return each.withColumn("_own", own).withColumn("_s", F.explode_outer(F.sequence("_own", F.floor((F.col("_t") + window - 1) / slice_s))))


def recent_count(rows: DataFrame, key: str, seconds: Column, window: int = WINDOW_S) -> DataFrame:
    """rows with n: those of the same key less than `window` seconds old, itself included. Rows without a time count those of
    their key.

    Attempts are counted by key and second before they are shuffled, and a key's time is cut into slices with the seconds
    before them, so a key that holds half of all rows is many small groups.
    """
    timed = rows.withColumn("_at", seconds.cast("long"))
    each = timed.groupBy(F.col(key).alias("_k"), F.col("_at").alias("_t")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_k", "_s").orderBy("_t").rangeBetween(-(window - 1), Window.currentRow)
    sums = seconds_sliced(each, window).withColumn("_n", F.sum("_c").over(w)).filter(F.col("_s").eqNullSafe(F.col("_own"))).select("_k", "_t", "_n")
    counted = timed.join(sums, timed[key].eqNullSafe(F.col("_k")) & F.col("_at").eqNullSafe(F.col("_t")))
    return counted.select(*[timed[c] for c in rows.columns], F.col("_n").alias("n"))


def renewals(events: DataFrame, days: int = 90) -> DataFrame:
    """(token, at, expires): each opening and renewal of sessions, of events (token, at in seconds, opens). A visit renews a
    session that has not expired and would then end more than a day later; one after the end does nothing. Of one second
    the opening counts first. A session's events are folded in one group: a row for each of its seconds."""
    each = events.groupBy("token", "at").agg(F.max(F.coalesce("opens", F.lit(False))).alias("opens"))
    zero = F.struct(F.lit(None).cast("long").alias("expires"), F.array().cast("array<struct<at:long,expires:long>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        end = e["at"] + days * 86_400
        moves = e["opens"] | F.coalesce((s["expires"] >= e["at"]) & (end - s["expires"] > RENEW_S), F.lit(False))
        return F.struct(F.when(moves, end).otherwise(s["expires"]).alias("expires"), F.when(moves, F.concat(s["out"], F.array(F.struct(e["at"].alias("at"), end.alias("expires"))))).otherwise(s["out"]).alias("out"))

    rows = each.groupBy("token").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "opens"))).alias("e"))
    return rows.select("token", F.inline(F.aggregate("e", zero, step, lambda s: s["out"])))


def blocked(attempts: DataFrame, now: int) -> DataFrame:
    """(what, value, n) of addresses and IPs over their limits."""
    recent = attempts.filter(F.col("at") > now - WINDOW_S)
    counts = recent.select(F.explode(F.array(F.struct(F.lit("ip").alias("what"), F.col("ip").alias("value")), F.struct(F.lit("email").alias("what"), F.col("email").alias("value")))).alias("x"))
    counts = counts.groupBy("x.what", "x.value").agg(F.count("*").alias("n"))
    return counts.filter(((F.col("what") == "ip") & (F.col("n") >= PER_IP)) | ((F.col("what") == "email") & (F.col("n") >= PER_EMAIL)))


def login_outcome(limited: Column, resend: Column, right: Column, verified: Column, status: Column) -> Column:
    """The first that holds."""
    return (
        F.when(limited, "limited").when(resend, "resend").when(~F.coalesce(right, F.lit(False)), "bad").when(~verified, "unverified")
        .when(status == "pending", "pending").when(status != "active", "inactive").otherwise("ok")
    )


def registration_error(limited: Column, email: Column, name: Column, password: Column, again: Column, taken: Column) -> Column:
    """The first fault, null if there is none."""
    address = F.rlike(email, F.lit(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"))
    return (
        F.when(limited, "limited").when(~address | (F.length(email) > 190), "email").when(F.length(name) > 100, "name")
        .when((F.length(password) < 8) | (F.length(password) > 200), "password").when(password != again, "mismatch").when(taken, "taken")
    )


def status_order(status: Column) -> Column:
    return F.when(status == "pending", 0).when(status == "active", 1).otherwise(2)


def norm_email(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def path_denied(path: Column) -> Column:
    return F.rlike(path, F.lit(DENIED))


def safe_next(target: Column, base: str) -> Column:
    """The target if it stays on this site and outside the login pages, else the base."""
    rest = F.substring(target, F.lit(len(base) + 1), F.length(target))
    ok = F.startswith(target, F.lit(base)) & ~F.startswith(target, F.lit("//")) & ~F.rlike(target, F.lit(r"[\\\s]")) & ~F.startswith(rest, F.lit("auth/"))
    return F.when(F.coalesce(ok, F.lit(False)), target).otherwise(F.lit(base))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def media_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit("application/octet-stream"))


def cache_policy(path: Column) -> Column:
    return F.concat(F.lit("private, "), F.when(extension(path).isin(*FRESH), "no-cache").otherwise("max-age=600"))


def etag(mtime: Column, size: Column) -> Column:
    return F.concat(F.lit('"'), F.lower(F.hex(mtime)), F.lit("-"), F.lower(F.hex(size)), F.lit('"'))


def byte_range(header: Column, size: Column) -> Column:
    """struct(status, first, last): 206 for a range that can be met, 416 for one that can't, else 200 and all."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(F.trim(header), r"^bytes=(\d*)-(\d*)$", k), F.lit("")), F.lit("999999999999999999")).cast("long") for k in (1, 2))
    first = F.when(a.isNotNull(), a).otherwise(F.greatest(F.lit(0).cast("long"), size - b))
    last = F.when(a.isNotNull() & b.isNotNull(), F.least(b, size - 1)).otherwise(size - 1)
    asked = a.isNotNull() | b.isNotNull()
    status = F.when(~asked, 200).when((first > last) | (first >= size), 416).otherwise(206)
    return F.struct(status.alias("status"), F.when(asked, first).otherwise(F.lit(0).cast("long")).alias("first"), F.when(asked, last).otherwise(size - 1).alias("last"))


def file_parameter(x: Column) -> Column:
    """A PDF under files/ without a step up, else null."""
    return F.when(F.rlike(x, F.lit(r"(?i)^files/[^?#]+\.pdf$")) & ~F.contains(x, F.lit("..")), x)


def file_title(x: Column) -> Column:
    """The last part of a file parameter, decoded, without its ending, underscores and blanks as one blank."""
    last = url_unquote(F.element_at(F.split(x, "/"), -1))
    return F.regexp_replace(F.regexp_replace(last, r"(?i)\.pdf$", ""), r"(?U)[_\s]+", " ")


def url_quote(x: Column) -> Column:
    """Percent encoding of all but letters, digits and -._~ (a form's encoding differs in three signs)."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(x, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_unquote(x: Column) -> Column:
    """Percent decoding; + stays, and so does a text that is not validly encoded."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def stale_versions(urls: DataFrame, current: str) -> DataFrame:
    """Cached URLs (column url) whose v parameter is another build's; those without one stay."""
    v = F.regexp_extract("url", r"[?&]v=([^&#]*)", 1)
    return urls.filter((v != "") & (v != current))


def worker_route(path: Column) -> Column:
    """How the site's worker answers: pages of the login from the network only, entry points from it first, the rest from
    the cache first."""
    fresh = F.rlike(path, F.lit(r"/$|/(?:index\.html|pdf\.html|meta\.json|tickets\.json|sw\.js)$"))
    return F.when(F.contains(path, F.lit("/auth/")), "network only").when(fresh, "network first").otherwise("cache first")


#: What a user's status is called.
STATUS = {"pending": "заявка", "active": "доступ открыт", "blocked": "заблокирован"}


def status_label(status: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, status), status)


def seen_text(created: Column, last_login: Column) -> Column:
    """Since when, and when last; a last login of 0 is none."""
    at = lambda x, form: F.date_format(F.timestamp_seconds(x), form)
    return F.concat(F.lit("с "), at(created, "dd.MM.yyyy"), F.when(last_login != 0, F.concat(F.lit(", последний вход "), at(last_login, "dd.MM.yyyy HH:mm"))).otherwise(""))


def who_json(users: DataFrame, pending: DataFrame) -> DataFrame:
    """(id, json) of what the site tells a user; only administrators learn how many applications wait. pending: one row."""
    admin = F.col("role") == "admin"
    shown = F.struct("email", "name", admin.alias("admin"), F.when(admin, F.col("pending")).otherwise(0).alias("pending"))
    return users.crossJoin(F.broadcast(pending.select("pending"))).select("id", F.to_json(shown).alias("json"))


def pending_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count(F.when((F.col("status") == "pending") & (F.col("verified") == 1), 1)).alias("pending"), F.count("*").alias("users"))


def _base64(x: Column) -> Column:
    """In one line, whatever the session's setting for long texts."""
    return F.regexp_replace(F.base64(x.cast("binary")), r"[\r\n]", "")


def mail_header(x: Column) -> Column:
    return F.concat(F.lit("=?UTF-8?B?"), _base64(x), F.lit("?="))


def mail_body(x: Column) -> Column:
    """Base64 in lines of 76, each with its end."""
    return F.regexp_replace(_base64(x), "(.{1,76})", "$1\r\n")
