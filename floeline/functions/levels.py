"""Threshold ladders. The three danger ladders differ on purpose and stay apart."""

from pyspark.sql import Column, functions as F

from floeline import schemas


def hourly_level(avg_conc: Column) -> Column:
    """Strictly above 0.7 / 0.4; NULL counts as safe."""
    return F.when(avg_conc > 0.7, "danger").when(avg_conc > 0.4, "caution").otherwise("safe")


def frame_level(conc: Column, sev: Column) -> Column:
    """Training label: either input may raise it."""
    return (
        F.when((conc > 0.7) | (sev > 0.55), "danger")
        .when((conc > 0.4) | (sev > 0.3), "caution")
        .otherwise("safe")
    )


def scene_level(field_cover: Column, load: Column) -> Column:
    """Dashboard ladder: thresholds included."""
    return (
        F.when((field_cover >= 0.35) | (load >= 0.45), "danger")
        .when((field_cover >= 0.16) | (load >= 0.20), "caution")
        .otherwise("ok")
    )


def metric_level(value: Column, caution: float, danger: float) -> Column:
    return F.when(value >= danger, "danger").when(value >= caution, "caution").otherwise("ok")


def field_level(value: Column) -> Column:
    return metric_level(value, 0.16, 0.35)


def ice_level(value: Column) -> Column:
    return metric_level(value, 0.30, 0.60)


def loose_level(value: Column) -> Column:
    return metric_level(value, 0.35, 0.65)


def largest_class(field: Column, broken: Column, slush: Column) -> Column:
    """Name of the largest ice class, the earlier one on ties."""
    return (
        F.when(field + broken + slush <= 0, "open_water")
        .when((field >= broken) & (field >= slush), "ice_field")
        .when(broken >= slush, "broken_ice")
        .otherwise("slush_ice")
    )


def scene_kind(ice_pixels: Column, field_cover: Column, pressure: Column, loose_share: Column) -> Column:
    return (
        F.when(ice_pixels == 0, "open_water")
        .when((field_cover >= 0.35) | (pressure >= 0.45), "dense_field")
        .when(field_cover >= 0.16, "mixed_ice")
        .when(loose_share >= 0.65, "loose_ice")
        .otherwise("sparse_ice")
    )


def label_class(kind: Column, largest: Column) -> Column:
    """Class named on the dashboard: a dense scene is always shown as solid ice."""
    return F.when(kind == "dense_field", "ice_field").otherwise(largest)


def note_code(field_cover: Column, loose_share: Column) -> Column:
    """Which summary sentence applies to the heaviest camera."""
    return (
        F.when(field_cover >= 0.35, "solid_field")
        .when((field_cover < 0.08) & (loose_share >= 0.65), "loose_only")
        .otherwise("peak_zone")
    )


def text(code: Column, labels: dict) -> Column:
    """Fixed value of a code, such as its display text."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.create_map(*pairs)[code]


def scene_text(kind: Column) -> Column:
    return text(kind, schemas.SCENE_LABELS)


def class_text(name: Column) -> Column:
    return text(name, schemas.CLASS_LABELS)
