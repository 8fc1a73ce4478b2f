"""Signals and events in log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name, pattern and severity of risk signals; case is of no account.
SIGNALS = (
    ("资源熔断", r"Resource type .* is currently disabled.*?failure:\s*\d+", "CRIT"),
    ("登录拒绝", r"Login Error.*ErrCode:\s*3", "CRIT"),
    ("版本过低", r"serverErrorCode\s*45|QQ版本过低", "WARN"),
    ("登录态失效", r"登录态已失效|登录失败|Process exited\.?", "WARN"),
    ("封号定性", r"账号.*(?:冻结|涉嫌|违规|被限制)|被限制登录", "CRIT"),
    ("频繁下线", r"被踢下线|强制下线", "WARN"),
)

#: Marks in log lines.
QR_SAVED, LOGIN_ERROR, QUICK_LOGIN, READY, VERSION, PANEL, QR_PROMPT = "二维码已保存到", "[Core] [Login] Login Error", "正在快速登录", "协议适配器初始化完成", "NapCat.Core Version:", "WebUi User Panel Url:", "请扫描下面的二维码"
LEVELS = r"\[(error|fatal|warn)\]"
TIMED = r"^\p{ASCII}{2}-\p{ASCII}{2} \p{ASCII}{2}:"


def plain_line(c: Column) -> Column:
    """Without colour codes and outer white space."""
    return F.regexp_replace(F.regexp_replace(c, r"\x1b\[[^A-Za-z]*[A-Za-z]", ""), r"^\s+|\s+$", "")


def risk_signals(lines: DataFrame, rules: tuple = SIGNALS) -> DataFrame:
    """lines: id, line. A row for each rule that a line meets: id, signal, severity."""
    met = F.array(*[F.when(F.col("line").rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("signal"), F.lit(severity).alias("severity"))) for name, pattern, severity in rules])
    return lines.select("id", F.explode(F.array_compact(met)).alias("m")).select("id", "m.*")


def log_events(lines: DataFrame) -> DataFrame:
    """lines: id, line. The event of each line that begins with a time and tells one, by the first rule that holds: id, event, detail."""
    line = F.col("line")
    after = lambda mark: F.trim(F.substring_index(line, mark, -1)) if mark == QR_SAVED else F.trim(F.regexp_replace(line, rf"^.*?\Q{mark}\E", ""))
    has = lambda mark: F.contains(line, F.lit(mark))
    account = F.regexp_extract(line, rf"^.*?\Q{QUICK_LOGIN}\E\s*(\S+)", 1)
    made = lambda event, detail: F.struct(F.lit(event).alias("event"), detail.cast("string").alias("detail"))
    event = (
        F.when(has(QR_SAVED) & (after(QR_SAVED) != ""), made("qr_saved", after(QR_SAVED)))
        .when(has(LOGIN_ERROR), made("login_error", line))
        .when(account != "", made("quick_login", account))
        .when(has(READY), made("adapter_ready", F.lit(None)))
        .when(has(VERSION), made("core_version", after(VERSION)))
        .when(has(PANEL), made("panel_url", after(PANEL)))
        .when(~has(QR_PROMPT) & line.rlike(LEVELS), made("diagnostic", line))
    )
    timed = lines.select("id", plain_line(line).alias("line")).where(line.rlike(TIMED) & (F.octet_length("line") > 14))
    return timed.select("id", event.alias("e")).where("e is not null").select("id", "e.*")


def log_stages(lines: DataFrame, key: str) -> DataFrame:
    """lines: key, id (their order), line. What each log tells at its end, the latest of each kind: account, qr, login_error (until a later code is shown), version, panel, ready, stamp."""
    named = lines.select(F.struct(key, "id").alias("id"), "line")
    e = log_events(named).select(f"id.{key}", F.col("id.id").alias("id"), "event", "detail")
    last = lambda name: F.max_by(F.when(F.col("event") == name, F.col("detail")), F.when(F.col("event") == name, F.col("id")))
    at = lambda name: F.max(F.when(F.col("event") == name, F.col("id")))
    seen = e.groupBy(key).agg(
        last("quick_login").alias("account"), last("qr_saved").alias("qr"), last("login_error").alias("__error"), at("login_error").alias("__error_at"), at("qr_saved").alias("__qr_at"),
        last("core_version").alias("version"), last("panel_url").alias("panel"), at("adapter_ready").alias("__ready"),
    )
    stamp = F.regexp_extract(plain_line(F.col("line")), r"^(\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    stamps = lines.select(key, "id", F.when(stamp != "", stamp).alias("s")).groupBy(key).agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("id"))).alias("stamp"))
    error = F.when(F.coalesce(F.col("__error_at") > F.coalesce("__qr_at", F.lit(-1)), F.lit(False)), F.col("__error"))
    return stamps.join(seen, key, "left").select(key, "account", "qr", error.alias("login_error"), "version", "panel", F.col("__ready").isNotNull().alias("ready"), "stamp")
