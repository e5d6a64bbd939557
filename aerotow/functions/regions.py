"""Country -> world region mapping and route flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Country codes of each region (must equal the reference lists).
REGION_COUNTRIES = {
    "Europe": ["GB", "FR", "DE", "ES", "IT", "SE", "CH", "NL", "AT", "IE", "BE", "DK", "FI", "GR", "HU",
               "IS", "LT", "LU", "LV", "MT", "NO", "PL", "PT", "RO", "SI", "SK", "CZ", "EE", "BG", "CY"],
    "North America": ["US", "CA", "MX"],
    "South America": ["BR", "AR", "CL", "CO", "PE", "VE", "UY", "PY", "BO", "EC", "GY", "SR"],
    "Middle East": ["AE", "SA", "IL", "IR", "IQ", "JO", "KW", "OM", "QA", "BH", "LB", "SY", "YE"],
    "Asia": ["JP", "CN", "KR", "IN", "PK", "BD", "VN", "PH", "TH", "MY", "ID", "SG", "MN", "KZ", "TM",
             "UZ", "KG"],
    "Africa": ["ZA", "NG", "EG", "DZ", "MA", "KE", "TZ", "GH", "ET", "CI", "SN", "SD", "AO", "LR", "RW", "ER"],
    "Oceania": ["AU", "NZ", "FJ", "PG"],
}
# Direction rules (departure region, arrival region) -> label.
DIRECTIONS = [("North America", "South America", "North_to_South"),
              ("Europe", "Asia", "West_to_East"),
              ("Asia", "Europe", "East_to_West")]


def region_table(spark: SparkSession) -> DataFrame:
    """(country, region) rows; a country listed twice keeps its first region."""
    seen, rows = set(), []
    for region, codes in REGION_COUNTRIES.items():
        for c in codes:
            if c not in seen:
                seen.add(c)
                rows.append((c, region))
    return spark.createDataFrame(rows, "country string, region string")


def region_of(code: Column, mapped: Column) -> Column:
    """Mapped region; codes outside the lists are 'Other', missing codes 'Unknown'."""
    return F.when(mapped.isNotNull(), mapped).when(code.isNotNull(), "Other").otherwise("Unknown")


def add_regions(df: DataFrame, dep_code: str = "country_code_adep",
                arr_code: str = "country_code_ades") -> DataFrame:
    """adep_region / ades_region via a broadcast join with the fixed mapping
    (about 95 rows, a fixed bound)."""
    m = F.broadcast(region_table(df.sparkSession))
    for code, out in ((dep_code, "adep_region"), (arr_code, "ades_region")):
        mm = m.select(F.col("country").alias("_cc"), F.col("region").alias("_rg"))
        df = (df.join(mm, F.col(code) == F.col("_cc"), "left")
                .withColumn(out, region_of(F.col(code), F.col("_rg"))).drop("_cc", "_rg"))
    return df


def route_flags(df: DataFrame) -> DataFrame:
    """same_country_flight, same_region_flight, flight_direction, is_intercontinental."""
    dr, ar = F.col("adep_region"), F.col("ades_region")
    direction = F.lit("Other")
    for dep, arr, label in reversed(DIRECTIONS):
        direction = F.when((dr == dep) & (ar == arr), label).otherwise(direction)
    known = list(REGION_COUNTRIES)
    return df.withColumns({
        # a missing code equals nothing (pandas NaN == NaN is False)
        "same_country_flight": F.coalesce(F.col("country_code_adep") == F.col("country_code_ades"),
                                          F.lit(False)).cast("int"),
        "same_region_flight": F.coalesce(dr == ar, F.lit(False)).cast("int"),
        "flight_direction": direction,
        "is_intercontinental": F.coalesce(dr.isin(*known) & ar.isin(*known) & (dr != ar),
                                          F.lit(False)).cast("int"),
    })
