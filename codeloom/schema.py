"""Tables of the code model, and how they relate."""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "module": "id bigint, name string, path string",
    "function": "id bigint, name string, function_signature string, raw_string string, src_loc string, module_name string, line_number_start int, line_number_end int, type_enum string, instances_used string, module_id bigint, function_input array<string>, function_output array<string>",
    "where_function": "id bigint, name string, function_signature string, raw_string string, src_loc string, parent_function_id bigint, depth int, path string",
    "function_called": "id bigint, module_name string, name string, package_name string, src_loc string, _type string, function_name string, function_signature string, type_enum string, function_id bigint, where_function_id bigint",
    "import": "id bigint, module_name string, package_name string, src_loc string, is_boot_source boolean, is_safe boolean, is_implicit boolean, as_module_name string, qualified_style string, is_hiding boolean, hiding_specs array<string>, line_number_start int, line_number_end int, module_id bigint",
    "type": "id bigint, type_name string, raw_code string, src_loc string, type_of_type string, line_number_start int, line_number_end int, module_id bigint",
    "constructor": "id bigint, name string, type_id bigint",
    "field": "id bigint, field_name string, field_type_raw string, field_type_structure string, constructor_id bigint",
    "class": "id bigint, class_name string, class_definition string, src_location string, line_number_start int, line_number_end int, module_id bigint",
    "instance": "id bigint, instance_definition string, instance_signature string, src_loc string, line_number_start int, line_number_end int, module_id bigint",
    "instance_function": "id bigint, instance_id bigint, function_id bigint",
    "function_dependency": "caller_id bigint, callee_id bigint",
    "type_dependency": "dependent_id bigint, dependency_id bigint",
}
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
SCHEMAS: dict[str, T.StructType] = {k: T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in v.split(", "))]) for k, v in _DDL.items()}

#: (parent, child) -> (parent's column, child's column).
RELATIONS: dict[tuple[str, str], tuple[str, str]] = {
    **{("module", c): ("id", "module_id") for c in ("import", "type", "class", "instance", "function")},
    ("function", "module"): ("module_id", "id"),
    ("function", "where_function"): ("id", "parent_function_id"),
    ("type", "constructor"): ("id", "type_id"),
    ("constructor", "field"): ("id", "constructor_id"),
    ("instance", "instance_function"): ("id", "instance_id"),
    ("function", "function_called"): ("id", "function_id"),
}
