"""Columns of Windows security events: access masks, living-off-the-land binaries, admin shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event format.
TARGET_EVENT_IDS = (4624, 4625, 4648, 4656, 4658, 4660, 4663, 4688, 4698, 5140, 5145, 7045, 1102)
FILE_ACCESS_EVENT_IDS = (4656, 4660, 4663, 5140, 5145)
CATEGORIES = {
    "authentication": (4624, 4625, 4648),
    "file_access": (4656, 4658, 4660, 4663, 5140, 5145),
    "process": (4688,),
    "persistence": (4698, 7045),
    "anti_forensics": (1102,),
}
BEHAVIOUR_FLAGS = {"is_read": 0x1, "is_write": 0x2, "is_append": 0x4, "is_read_ea": 0x8, "is_write_ea": 0x10, "is_delete": 0x10000, "is_write_dac": 0x40000}
ACCESS_FLAGS = {
    "ReadData": 0x1, "WriteData": 0x2, "AppendData": 0x4, "ReadEA": 0x8, "WriteEA": 0x10, "Execute": 0x20, "DeleteChild": 0x40,
    "ReadAttributes": 0x80, "WriteAttributes": 0x100, "DELETE": 0x10000, "READ_CONTROL": 0x20000, "WRITE_DAC": 0x40000,
    "WRITE_OWNER": 0x80000, "SYNCHRONIZE": 0x100000,
}
#: Fixed values that lolbin flags need to be right: names of Windows' own programs that intruders use. The default of is_lolbin().
LOLBINS = (
    "powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "wmic.exe", "msiexec.exe", "regsvr32.exe",
    "rundll32.exe", "certutil.exe", "bitsadmin.exe", "schtasks.exe", "sc.exe", "net.exe", "net1.exe", "psexec.exe", "psexesvc.exe",
    "wmiprvse.exe", "at.exe", "reg.exe", "tasklist.exe", "nltest.exe", "dsquery.exe", "csvde.exe", "ldifde.exe", "ntdsutil.exe",
    "procdump.exe", "7z.exe", "winrar.exe", "rar.exe", "tar.exe", "curl.exe", "wget.exe",
)
ADMIN_SHARES = ("C$", "ADMIN$", "IPC$", "D$", "E$")


def event_category(event_id: Column) -> Column:
    found = F.lit("unknown")
    for name, ids in CATEGORIES.items():
        found = F.when(event_id.isin(*ids), name).otherwise(found)
    return found


def hex_to_int(text: Column) -> Column:
    """A decimal or 0x mask as a long; null, blank, '-', 'nan', '%%...' and whatever else isn't a number give 0."""
    clean = F.lower(F.trim(text))
    is_hex = clean.rlike("^0x[0-9a-f]{1,15}$")
    is_decimal = clean.rlike("^[0-9]{1,18}$")
    return F.coalesce(
        F.when(is_hex, F.conv(F.substring(clean, 3, 15), 16, 10).cast("bigint")).when(is_decimal, F.expr("0L") + F.when(is_decimal, clean).cast("bigint")),
        F.lit(0).cast("bigint"),
    )


def behaviour_flags(event_id: Column, mask: Column) -> dict[str, Column]:
    """The seven behaviour flags of a mask; false for events that carry no mask."""
    number, carries = hex_to_int(mask), F.coalesce(event_id.isin(*FILE_ACCESS_EVENT_IDS), F.lit(False))
    return {name: carries & (number.bitwiseAND(F.lit(bit)) != 0) for name, bit in BEHAVIOUR_FLAGS.items()}


def decode_access_mask(mask: Column) -> Column:
    """Names of the flags set in a mask, lowest bit first."""
    number = hex_to_int(mask)
    return F.array_compact(F.array(*(F.when(number.bitwiseAND(F.lit(bit)) != 0, name) for name, bit in ACCESS_FLAGS.items())))


def is_lolbin(*paths: Column, names: tuple[str, ...] = LOLBINS) -> Column:
    """Whether the file name after the last backslash of any path is a known binary."""
    named = [F.lower(F.element_at(F.split(F.coalesce(p, F.lit("")), r"\\"), -1)).isin(*names) for p in paths]
    found = named[0]
    for x in named[1:]:
        found = found | x
    return found


def is_admin_share(object_name: Column, share_name: Column) -> Column:
    def holds(c: Column) -> Column:
        upper = F.upper(F.coalesce(c, F.lit("")))
        found = upper.contains(ADMIN_SHARES[0])
        for share in ADMIN_SHARES[1:]:
            found = found | upper.contains(share)
        return found

    return holds(object_name) | holds(share_name)
