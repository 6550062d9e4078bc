"""Location from repeated observations of one (parent, place) key.

Every observation of a group counts; none is dropped to make a location usable. Rows are first reduced to distinct
pairs by the normal form of their numbers, then to groups, so a group of any size is combined before it is shuffled. The candidates behind an unresolved
location stay a table of their own instead of an array inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.locators import locator_order
from ..functions.numbers import NUMBER, SCALE7, decimal_token, normal_number, within
from ..session import materialize

# The classes of one observation.
TOKEN, INCOMPLETE = "invalid_coordinate_token", "incomplete_coordinate_observation"
LATITUDE, LONGITUDE = "latitude_out_of_range", "longitude_out_of_range"

RESULT = ["observation_count", "coordinate_pair_count", "latitude", "longitude", "location_record_id", "map_eligible",
          "reason_code", "resolution"]


def _absent(token: Column) -> Column:
    return token.isNull() | (token == "")


def classify(lat: Column, lon: Column) -> Column:
    """NULL for a usable observation, else the first thing wrong with it. A number of any length is a number, but may be out of range."""
    return (F.when(~_absent(lat) & ~lat.rlike(NUMBER), TOKEN)
            .when(~_absent(lon) & ~lon.rlike(NUMBER), TOKEN)
            .when(_absent(lat) | _absent(lon), INCOMPLETE)
            .when(~within(lat, 90), LATITUDE)
            .when(~within(lon, 180), LONGITUDE))


def resolve(observations: DataFrame, keys: list[str], latitude: str, longitude: str, crs_confirmed: bool) -> DataFrame:
    """One row per key. observations also carry raw_record_id, file_sha256, parser_version and row_locator."""
    order = F.struct("file_sha256", "parser_version", locator_order("row_locator"), "raw_record_id")
    marked = observations.select(
        *keys, decimal_token(latitude).alias("lat"), decimal_token(longitude).alias("lon"),
        normal_number(latitude).alias("lat_text"), normal_number(longitude).alias("lon_text"),
        classify(F.col(latitude), F.col(longitude)).alias("defect"), "raw_record_id", order.alias("ord"))
    coordinates = ["lat_text", "lon_text", "lat", "lon"]
    by_pair = (marked.withColumns({name: F.when(F.col("defect").isNull(), F.col(name)) for name in coordinates})
               .groupBy(*keys, "defect", *coordinates)
               .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "raw_record_id")).alias("lowest")))
    usable = F.col("defect").isNull()
    groups = by_pair.groupBy(*keys).agg(
        F.sum("n").alias("observation_count"),
        F.count_if(usable).alias("pairs"),
        F.min(F.when(usable, F.col("lat"))).alias("lat"), F.min(F.when(usable, F.col("lon"))).alias("lon"),
        F.min("lowest").alias("lowest"),
        F.min_by("defect", F.when(~usable, F.col("lowest"))).alias("defect"))
    return decide(groups, keys, crs_confirmed)


def decide(groups: DataFrame, keys: list[str], crs_confirmed: bool) -> DataFrame:
    defect, conflict = F.col("defect").isNotNull(), F.col("pairs") > 1
    eligible = ~defect & ~conflict & F.lit(crs_confirmed)
    reason = (F.when(defect, "invalid_coordinate").when(conflict, "location_conflict")
              .when(F.lit(not crs_confirmed), "crs_unconfirmed").otherwise(""))
    resolution = (F.when(defect, F.col("defect")).when(conflict, "conflicting_coordinate_observations")
                  .when(F.lit(not crs_confirmed), "coordinates_agree_but_crs_is_unconfirmed")
                  .otherwise("equivalent_observations_resolved"))
    return groups.select(
        *keys, "observation_count",
        F.when(defect, F.lit(0).cast("bigint")).otherwise(F.col("pairs")).alias("coordinate_pair_count"),
        F.when(eligible, F.col("lat")).cast(SCALE7).alias("latitude"),
        F.when(eligible, F.col("lon")).cast(SCALE7).alias("longitude"),
        F.when(eligible, F.col("lowest.raw_record_id")).alias("location_record_id"),
        eligible.alias("map_eligible"), reason.alias("reason_code"), resolution.alias("resolution"))


def locate(targets: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Every target with its decision; a target without observations is kept as no_location."""
    # Decisions are written first: joined to a plain table, a place that very many targets share can be split.
    out = targets.join(materialize(resolved, "resolved"), keys, "left")
    none = F.col("observation_count").isNull()
    zero = F.lit(0).cast("bigint")
    return (out.withColumn("map_eligible", F.coalesce("map_eligible", F.lit(False)))
            .withColumn("reason_code", F.when(none, "no_location").otherwise(F.col("reason_code")))
            .withColumn("resolution", F.when(none, "no_matching_observation").otherwise(F.col("resolution")))
            .withColumn("coordinate_pair_count", F.coalesce("coordinate_pair_count", zero))
            .withColumn("observation_count", F.coalesce("observation_count", zero)))


def candidates(targets: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Observations behind each unresolved target, one row each: the long form of a candidate list."""
    # One row for each place, however many targets share it.
    open_targets = materialize(targets.filter(~F.col("map_eligible")).select(*keys, "reason_code").distinct(), "open_targets")
    return observations.join(open_targets, keys).select(
        *keys, "reason_code", "raw_record_id", "file_sha256", "parser_version", "row_locator")
