"""Names, types and units of the standard properties, and vendors' names for them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


@dataclass(frozen=True)
class Property:
    name: str
    kind: str  # "integer" or "float"

    @property
    def spark(self) -> T.DataType:
        return T.LongType() if self.kind == "integer" else T.DoubleType()


#: The standard property names and kinds.
PROPERTIES = {
    p.name: p
    for p in [
        Property("original_index", "integer"), Property("position_x", "float"), Property("position_y", "float"), Property("position_z", "float"),
        Property("frame", "integer"), Property("frames_number", "integer"), Property("frames_missing", "integer"), Property("time", "float"),
        Property("intensity", "float"), Property("local_background", "float"), Property("local_background_sigma", "float"), Property("signal_noise_ratio", "float"), Property("signal_background_ratio", "float"),
        Property("chi_square", "float"), Property("two_kernel_improvement", "float"), Property("psf_amplitude", "float"),
        Property("psf_width", "float"), Property("psf_width_x", "float"), Property("psf_width_y", "float"), Property("psf_width_z", "float"),
        Property("psf_half_width", "float"), Property("psf_half_width_x", "float"), Property("psf_half_width_y", "float"), Property("psf_half_width_z", "float"),
        Property("psf_sigma", "float"), Property("psf_sigma_x", "float"), Property("psf_sigma_y", "float"), Property("psf_sigma_z", "float"),
        Property("uncertainty", "float"), Property("uncertainty_x", "float"), Property("uncertainty_y", "float"), Property("uncertainty_z", "float"),
        Property("channel", "integer"), Property("slice_z", "float"), Property("plane", "integer"), Property("cluster_label", "integer"),
    ]
}

COORDINATES = ("position_x", "position_y", "position_z")


class FileType(Enum):
    CUSTOM = 1
    RAPIDSTORM = 2
    ELYRA = 3
    THUNDERSTORM = 4
    ASDF = 5
    NANOIMAGER = 6
    RAPIDSTORMTRACK = 7
    SMLM = 8
    DECODE = 9
    SMAP = 10


class HullType(Enum):
    BOUNDING_BOX = "bounding_box"
    CONVEX_HULL = "convex_hull"
    ORIENTED_BOUNDING_BOX = "oriented_bounding_box"
    ALPHA_SHAPE = "alpha_shape"


#: vendors' column names.
RAPIDSTORM = {
    "Position-0-0": "position_x", "Position-1-0": "position_y", "Position-2-0": "position_z", "ImageNumber-0-0": "frame", "Amplitude-0-0": "intensity", "FitResidues-0-0": "chi_square",
    "LocalBackground-0-0": "local_background", "TwoKernelImprovement-0-0": "two_kernel_improvement", "Position-0-0-uncertainty": "uncertainty_x", "Position-1-0-uncertainty": "uncertainty_y", "Position-2-0-uncertainty": "uncertainty_z",
}
ELYRA = {
    "Index": "original_index", "First Frame": "frame", "Number Frames": "frames_number", "Frames Missing": "frames_missing", "Position X [nm]": "position_x", "Position Y [nm]": "position_y", "Position Z [nm]": "position_z", "Precision [nm]": "uncertainty",
    "Number Photons": "intensity", "Background variance": "local_background_sigma", "Chi square": "chi_square", "PSF half width [nm]": "psf_half_width", "PSF width [nm]": "psf_width", "Channel": "channel", "Z Slice": "slice_z",
}
THUNDERSTORM = {
    "id": "original_index", "frame": "frame", "x [nm]": "position_x", "y [nm]": "position_y", "z [nm]": "position_z", "uncertainty [nm]": "uncertainty", "uncertainty_xy [nm]": "uncertainty_x", "uncertainty_z [nm]": "uncertainty_z",
    "intensity [photon]": "intensity", "offset [photon]": "local_background", "bkgstd [photon]": "local_background_sigma", "chi2": "chi_square", "sigma1 [nm]": "psf_sigma_x", "sigma2 [nm]": "psf_sigma_y", "sigma [nm]": "psf_sigma", "detections": "frames_number",
}
NANOIMAGER = {"Channel": "channel", "Frame": "frame", "X (nm)": "position_x", "Y (nm)": "position_y", "Z (nm)": "position_z", "Photons": "intensity", "Background": "local_background"}
SMLM = {
    "id": "original_index", "frame": "frame", "x": "position_x", "y": "position_y", "z": "position_z", "x_position": "position_x", "y_position": "position_y", "z_position": "position_z", "uncertainty [nm]": "uncertainty", "uncertainty_xy [nm]": "uncertainty_x",
    "uncertainty_z [nm]": "uncertainty_z", "intensity": "intensity", "Amplitude_0_0": "intensity", "background": "local_background", "LocalBackground_0_0": "local_background", "FitResidues_0_0": "chi_square",
}
DECODE = {"id": "original_index", "frame_ix": "frame", "x": "position_x", "y": "position_y", "z": "position_z", "bg": "local_background", "phot": "intensity"}
SMAP = {"frame": "frame", "xnm": "position_x", "ynm": "position_y", "znm": "position_z", "bg": "local_background", "phot": "intensity", "channel": "channel", "xnmerr": "uncertainty_x", "ynmerr": "uncertainty_y", "znmerr": "uncertainty_z"}


def coordinates(columns: list[str]) -> list[str]:
    """The position columns that exist, in order of axis."""
    return [c for c in COORDINATES if c in columns]


def per_dimension(columns: list[str], name: str) -> list[str | None]:
    """For each coordinate the column of ``name`` along its axis, or the isotropic one, or None."""
    out = []
    for c in coordinates(columns):
        own = f"{name}_{c[-1]}"
        out.append(own if own in columns else name if name in columns else None)
    return out


def fresh(name: str, columns: list[str], extension: str = "_0") -> str:
    """``name`` with the extension added until no column has it."""
    while name in columns:
        name += extension
    return name


def check_columns(columns: list[str], wanted: str | list[str] | None) -> list[str]:
    """The wanted columns as a list, or all coordinates; KeyError for one that is missing."""
    if wanted is None:
        return coordinates(columns)
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    for c in wanted:
        if c not in columns:
            raise KeyError(f"no column {c}")
    return wanted
