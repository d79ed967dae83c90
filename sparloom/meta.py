"""What a matrix file says about itself, and which kinds are valid or supported."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the exchange format.
BANNER = "%%MatrixMarket"
OBJECTS = ("matrix",)
FORMATS = ("coordinate", "array")
FIELDS = ("real", "complex", "pattern", "integer")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


class MatrixFormatError(ValueError):
    """A file that can't be read as what it says to be."""


@dataclass(frozen=True)
class MatrixMeta:
    object: str = "matrix"
    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"
    m: int = 0
    n: int = 0
    nz: int | None = None

    def with_nz(self, nz: int) -> MatrixMeta:
        return replace(self, nz=nz)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.object, self.format, self.field, self.symmetry, self.m, self.n, self.nz)], "object string, format string, field string, symmetry string, m long, n long, nz long")

    def typecode(self) -> str:
        return " ".join((self.object, self.format, self.field, self.symmetry))


def is_valid_typecode(meta: MatrixMeta) -> bool:
    """Whether object, format, field and symmetry can go together."""
    return (
        meta.object == "matrix"
        and not (meta.format == "array" and meta.field == "pattern")
        and not (meta.field == "real" and meta.symmetry == "hermitian")
        and not (meta.field == "pattern" and meta.symmetry in ("hermitian", "skew-symmetric"))
    )


def valid_typecode(object: str = "object", format: str = "format", field: str = "field", symmetry: str = "symmetry") -> Column:
    """The same rule over columns."""
    dense_pattern = (F.col(format) == "array") & (F.col(field) == "pattern")
    real_hermitian = (F.col(field) == "real") & (F.col(symmetry) == "hermitian")
    pattern_signed = (F.col(field) == "pattern") & F.col(symmetry).isin("hermitian", "skew-symmetric")
    return (F.col(object) == "matrix") & ~dense_pattern & ~real_hermitian & ~pattern_signed


def supported(format: str = "format", field: str = "field") -> Column:
    """The rule of check_supported() over columns."""
    return (F.col(format) == "coordinate") & (F.col(field) != "complex")


def check_supported(meta: MatrixMeta) -> None:
    """Products take coordinate files of real, integer or pattern entries."""
    if meta.format != "coordinate":
        raise MatrixFormatError(f"only coordinate files are supported, not {meta.format}")
    if meta.field == "complex":
        raise MatrixFormatError("complex entries have no product here; read_mm_raw reads them")
