"""Columns that several log kinds share: hours, verdicts, addresses, distances, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Codes of the actions and programs of mail and login logs.
MAIL_ACTION_CODES = {"Login": 1, "Logged out": 2, "Disconnected": 3}
AUTH_ACTION_CODES = {
    "Login Success": 1, "Login Failed": -1, "Disconnected": 2, "Session Opened": 3, "Session Closed": 4, "Systemd Session Opened": 5,
    "Privilege Escalation (su)": 10, "Sudo Command": 11,
}
PROGRAM_CODES = {"sshd": 1, "auth": 2, "su": 3, "sudo": 4, "systemd": 5, "systemd-logind": 5}
PRIVILEGED_ACTIONS = ("Privilege Escalation (su)", "Sudo Command")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without or with a zone (the session's is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def encode(value: Column, codes: dict[str, int], default: int = 0) -> Column:
    found = F.lit(default)
    for name, code in codes.items():
        found = F.when(value == name, code).otherwise(found)
    return found


#: Hours that count as off hours: of file servers, of mail and login logs, of web sessions, and of the login rule.
OFF_HOURS = {
    "file": lambda h: ~h.between(8, 17),
    "mail": lambda h: (h >= 22) | (h <= 5),
    "web": lambda h: (h < 6) | (h > 18),
    "rule": lambda h: h.between(2, 5),
}


def is_off_hours(ts: Column, kind: str) -> Column:
    return OFF_HOURS[kind](F.hour(ts))


def is_remote(rip: Column, lip: Column) -> Column:
    """0 if both addresses are the same and known, else 1."""
    return F.when(rip.isNotNull() & rip.eqNullSafe(lip), 0).otherwise(1)


def severity(score: Column, is_attack: Column, critical: float = 0.70) -> Column:
    return F.when(is_attack & (score >= critical), "CRITICAL").when(is_attack, "WARNING").otherwise("NORMAL")


#: Suspicious and critical scores of the sensitivity presets.
SENSITIVITY = {"low": (80, 90), "balanced": (60, 80), "high": (40, 60)}


def threat_level(statistical: Column, sequence: Column, has_signature: Column, suspicious: float = 50, critical: float = 80) -> Column:
    top = F.greatest(statistical, sequence)
    return F.when(has_signature | (top >= critical), "CRITICAL").when(top >= suspicious, "SUSPICIOUS").otherwise("NORMAL")


def binary_label(label: Column) -> Column:
    """1 unless the label is NORMAL in any case and with any space around; null stays null."""
    return F.when(label.isNull(), None).otherwise((F.upper(F.trim(label)) != "NORMAL").cast("int"))


def ip_to_long(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = sum((F.when(ok, F.get(parts, i)).cast("bigint") * 256 ** (3 - i) for i in range(1, 4)), F.when(ok, F.get(parts, 0)).cast("bigint") * 256**3)
    valid = ~F.exists(F.when(ok, parts), lambda x: x.cast("int") > 255)
    return F.when(ok & valid, number)


#: First and last addresses of private and local ranges.
PRIVATE_RANGES = (("10.0.0.0", "10.255.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"))


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_private_ip(ip: Column) -> Column:
    number = ip_to_long(ip)
    found = F.lit(False)
    for lo, hi in PRIVATE_RANGES:
        found = found | number.between(_number(lo), _number(hi))
    return F.coalesce(found, F.lit(False))


def is_lan_prefix(ip: Column) -> Column:
    """The crude test of the login rules: any address that begins with 172., 192. or 10."""
    return ip.startswith("172.") | ip.startswith("192.") | ip.startswith("10.")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def shannon_entropy(text: Column, digits: int = 4) -> Column:
    """Entropy of a text's characters in bits; 0 of null and empty texts. One pass per distinct character."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(bits, digits))
