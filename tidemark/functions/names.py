"""Names, sizes and paths: as column expressions, and a small parser for single paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col

#: Bytes of each unit: fixed values.
UNITS = {"kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}


def size_to_bytes(size: str | int | float) -> int:
    """Bytes of "100MB"; plain numbers pass, anything else is an error."""
    if isinstance(size, int | float):
        return int(size)
    m = re.fullmatch(r"\s*([-+.\deE]+)\s*([kmgt]b)\s*", size.lower())
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return int(float(m[1]) * UNITS[m[2]])


def bytes_of(size: ColumnOrName) -> Column:
    """The same for a text column; NULL where it is no size."""
    s = F.lower(F.trim(col(size)))
    number = F.regexp_extract(s, r"^([-+.\de]+)\s*[kmgt]b$", 1).try_cast("double")
    unit = F.right(s, F.lit(2))
    factor = F.when(unit == "kb", 1024.0).when(unit == "mb", 1024.0**2).when(unit == "gb", 1024.0**3).when(unit == "tb", 1024.0**4)
    return F.floor(number * factor)


def readable_bytes(n: ColumnOrName) -> Column:
    """"5.00 GB"; ties go to the even digit, as C formats them."""
    n = col(n).cast("double")
    out = F.format_string("%.2f PB", F.bround(n / 1024.0**5, 2))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(n / 1024.0**k, 2))).otherwise(out)
    return F.when(n >= 0, out)


def short_id(seed: ColumnOrName, length: int = 6) -> Column:
    return F.substring(F.md5(col(seed)), 1, length)


def format_bounds(*edges: ColumnOrName, precision: int = 6) -> Column:
    return F.concat_ws("_", *[F.format_string(f"%.{precision}f", col(e).cast("double")) for e in edges])


def _half(prefixes: tuple[str, str], value: Column, width: int, precision: int) -> Column:
    text = F.format_string(f"%0{width + precision + (precision > 0)}.{precision}f", F.bround(F.abs(value), precision))
    return F.concat(F.when(value >= 0, F.lit(prefixes[0])).otherwise(F.lit(prefixes[1])), F.replace(text, F.lit("."), F.lit("")))


def bounds_name(xmin: ColumnOrName, ymin: ColumnOrName, precision: int = 0) -> Column:
    """"n45e123" of the lower left corner in degrees."""
    return F.concat(_half(("n", "s"), col(ymin).cast("double"), 2, precision), _half(("e", "w"), col(xmin).cast("double"), 3, precision))


def bounds_name_with_hash(xmin: ColumnOrName, ymin: ColumnOrName, xmax: ColumnOrName, ymax: ColumnOrName, precision: int = 6, length: int = 6) -> Column:
    """The corner, both parts two digits wide at least, and the hash of the formatted bounds."""
    text = format_bounds(xmin, ymin, xmax, ymax, precision=precision)
    return F.concat(_half(("n", "s"), col(ymin).cast("double"), 2, 0), _half(("e", "w"), col(xmin).cast("double"), 2, 0), F.lit("-"), short_id(text, length))


def signed(href: ColumnOrName, account: str = "account", token: str | None = None) -> Column:
    """az:// and abfs:// become https addresses; a token is appended; other protocols give NULL."""
    h = col(href)
    cloud = F.regexp_extract(h, r"^(?:az|abfs)://(.*)$", 1)
    url = F.when(cloud != "", F.concat(F.lit(f"https://{account}.blob.core.windows.net/"), cloud)).when(h.startswith("https://"), h)
    if not token:
        return url
    return F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(token.lstrip("?")))


def zero_padded_ids(ids: ColumnOrName, widths: tuple[Column, Column, Column]) -> Column:
    """"cl{a}s{b}tr{c}" with its three numbers padded to the widths."""
    c = col(ids)
    part = lambda k: F.regexp_extract(c, r"^cl(\d+)s(\d+)tr(\d+)$", k)
    pad = lambda k: F.lpad(part(k), F.greatest(widths[k - 1], F.length(part(k))), F.lit("0"))
    return F.concat(F.lit("cl"), pad(1), F.lit("s"), pad(2), F.lit("tr"), pad(3))


def is_date(text: ColumnOrName) -> Column:
    """Whether a text is a day of the calendar, written yyyy-mm-dd; NULL is none."""
    t = col(text)
    return t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()


def zoom_of(path: ColumnOrName) -> Column:
    """The number after _z or a leading z in a file name; NULL without one."""
    return F.nullif(F.regexp_extract(file_name(path), r"(?:^|_)z(\d+)", 1), F.lit("")).cast("int")


def buffer_of(path: ColumnOrName) -> Column:
    """Metres in a file name (5000m); NULL without any."""
    return F.nullif(F.regexp_extract(file_name(path), r"(?:^|_)(\d+)m(?:_|\.|$)", 1), F.lit("")).cast("int")


def protocol(path: ColumnOrName) -> Column:
    p = F.regexp_extract(col(path), r"^([a-z0-9+.-]+)://", 1)
    return F.when(p == "", F.lit("file")).otherwise(p)


def file_name(path: ColumnOrName) -> Column:
    return F.regexp_extract(F.regexp_replace(col(path), r"[?#].*$", ""), r"([^/]*)$", 1)


def stem(path: ColumnOrName) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def suffix(path: ColumnOrName) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


_BLOB = ".blob.core.windows.net"


@dataclass(frozen=True)
class PathParts:
    """A local, az:// or https path of a container: bucket, key and name; band and resolution go into the name."""

    protocol: str
    bucket: str
    key: str
    name: str
    account: str | None = None
    directory: str = ""
    band: str | None = None
    resolution: str | None = None

    @classmethod
    def parse(cls, path: str, account: str | None = None) -> PathParts:
        u = urlparse(path)
        if u.scheme in ("", "file"):
            head, _, name = (u.path or path).rpartition("/")
            return cls("file", "", "", name, account, head)
        if u.scheme in ("az", "abfs"):
            bucket, parts = u.netloc, u.path.strip("/").split("/")
        elif u.scheme == "https" and u.netloc.endswith(_BLOB):
            account = u.netloc.removesuffix(_BLOB)
            bucket, *parts = u.path.strip("/").split("/")
        else:
            raise ValueError(f"not a path of a known store: {path!r}")
        return cls(u.scheme, bucket, "/".join(parts[:-1]), parts[-1] if parts else "", account)

    def with_(self, **changes) -> PathParts:
        return replace(self, **changes)

    @property
    def filename(self) -> str:
        base, dot, end = self.name.rpartition(".")
        extra = "".join(f"_{x}" for x in (self.band, self.resolution) if x)
        return f"{base}{extra}{dot}{end}" if dot else f"{self.name}{extra}"

    @property
    def path(self) -> str:
        return "/".join(x for x in (self.bucket, self.key, self.filename) if x)

    def uri(self) -> str:
        if not self.bucket:
            raise ValueError("a local path has no address in a store")
        return f"az://{self.path}"

    def url(self) -> str:
        if not self.bucket or not self.account:
            raise ValueError("an https address needs a bucket and an account")
        return f"https://{self.account}{_BLOB}/{self.path}"

    def local(self) -> str:
        return "/".join(x for x in (self.directory, self.filename) if x)
