"""Error codes of the array interface, as exceptions that carry code and name."""

from __future__ import annotations

# Names, codes and messages of the errors that are reported here.
ERRORS: dict[str, tuple[int, str]] = {
    "NC_NOERR": (0, "No error"),
    "NC_EBADID": (-33, "Not a valid ID"),
    "NC_EEXIST": (-35, "File exists and noclobber is set"),
    "NC_EINVAL": (-36, "Invalid argument"),
    "NC_EPERM": (-37, "Write to read only"),
    "NC_ENOTINDEFINE": (-38, "Operation not allowed in data mode"),
    "NC_EINDEFINE": (-39, "Operation not allowed in define mode"),
    "NC_EINVALCOORDS": (-40, "Index exceeds dimension bound"),
    "NC_ENAMEINUSE": (-42, "String match to name in use"),
    "NC_ENOTATT": (-43, "Attribute not found"),
    "NC_EBADTYPE": (-45, "Not a valid data type or _FillValue type mismatch"),
    "NC_EBADDIM": (-46, "Invalid dimension ID or name"),
    "NC_EUNLIMPOS": (-47, "Unlimited dimension in the wrong index"),
    "NC_ENOTVAR": (-49, "Variable not found"),
    "NC_ENOTNC": (-51, "Unknown file format"),
    "NC_EUNLIMIT": (-54, "Only one unlimited dimension is allowed"),
    "NC_ECHAR": (-56, "Attempt to convert between text and numbers"),
    "NC_EEDGE": (-57, "Start and count exceed dimension bound"),
    "NC_ESTRIDE": (-58, "Illegal stride"),
    "NC_EBADNAME": (-59, "Name contains illegal characters"),
    "NC_ERANGE": (-60, "Numeric conversion not representable"),
    "NC_EVARSIZE": (-62, "One or more variable sizes violate format constraints"),
    "NC_EDIMSIZE": (-63, "Invalid dimension size"),
    "NC_EIOMISMATCH": (-209, "Sizes of request and buffer differ"),
    "NC_ENEGATIVECNT": (-210, "Negative count is prohibited"),
    "NC_EINVAL_REQUEST": (-212, "Invalid nonblocking request ID"),
    "NC_EPREVATTACHBUF": (-216, "Previous attached buffer is found"),
    "NC_ENULLABUF": (-217, "Attached buffer is null"),
    "NC_EPENDINGBPUT": (-218, "Pending bput found, cannot detach buffer"),
    "NC_EINSUFFBUF": (-219, "Attached buffer is too small"),
    "NC_ENOENT": (-220, "File does not exist"),
    "NC_ENULLSTART": (-226, "Argument start is missing"),
    "NC_ESTRICTCDF2": (-232, "Attempting a new data type or interface in an old file format"),
    "NC_ENOTRECVAR": (-233, "Not a record variable"),
    "NC_ENOTFILL": (-234, "Fill mode is off for the variable"),
    "NC_EMULTIDEFINE_DIM_NUM": (-252, "Numbers of dimensions differ"),
    "NC_EMULTIDEFINE_DIM_SIZE": (-253, "Sizes of a dimension differ"),
    "NC_EMULTIDEFINE_DIM_NAME": (-254, "Names of a dimension differ"),
    "NC_EMULTIDEFINE_VAR_NUM": (-255, "Numbers of variables differ"),
    "NC_EMULTIDEFINE_VAR_NAME": (-256, "Names of a variable differ"),
    "NC_EMULTIDEFINE_VAR_NDIMS": (-257, "Ranks of a variable differ"),
    "NC_EMULTIDEFINE_VAR_DIMIDS": (-258, "Dimensions of a variable differ"),
    "NC_EMULTIDEFINE_VAR_TYPE": (-259, "Types of a variable differ"),
    "NC_EMULTIDEFINE_NUMRECS": (-261, "Numbers of records differ"),
    "NC_EMULTIDEFINE_ATTR_NUM": (-263, "Numbers of attributes differ"),
    "NC_EMULTIDEFINE_ATTR_TYPE": (-266, "Types of an attribute differ"),
    "NC_EMULTIDEFINE_ATTR_LEN": (-267, "Lengths of an attribute differ"),
    "NC_EMULTIDEFINE_ATTR_VAL": (-268, "Values of an attribute differ"),
}


def strerror(name_or_code: str | int) -> str:
    """The message of an error, by name or code."""
    if isinstance(name_or_code, str):
        return ERRORS[name_or_code][1]
    return next((text for code, text in ERRORS.values() if code == name_or_code), f"Unknown error code {name_or_code}")


class ArrayError(Exception):
    """An error of the array interface; ``name`` and ``code`` tell which."""

    def __init__(self, name: str, detail: str = ""):
        self.name, self.code = name, ERRORS[name][0]
        super().__init__(f"{name}: {ERRORS[name][1]}{': ' + detail if detail else ''}")


class StallError(RuntimeError):
    """Nothing moved for longer than a wait may last."""


class OverlapError(ArrayError):
    def __init__(self, detail: str):
        super().__init__("NC_EINVAL", detail)
