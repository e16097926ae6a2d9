"""The kinds of declarations, by what a rule may do with them; and predicates on observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALLABLE = (
    "function", "function_binding", "function_overload", "method", "trait_method", "interface_method", "local_function", "constructor",
    "factory_constructor", "redirecting_factory_constructor", "getter", "setter", "macro", "variable", "local", "parameter",
)
CALLABLE_CONTAINER = (*CALLABLE, "class", "struct", "enum", "trait", "interface", "record", "mixin", "extension")
CONTAINER = (*CALLABLE, "class", "struct", "enum", "trait", "interface", "record", "mixin", "extension", "extension_type", "namespace", "module")
MEMBER = ("method", "trait_method", "interface_method", "field", "property", "getter", "setter", "constructor", "factory_constructor")
TYPE = ("class", "struct", "enum", "trait", "interface", "record", "mixin", "extension", "extension_type", "type", "type_alias", "type_parameter", "namespace", "module")
NO_VALUE = ("interface", "type_alias", "type_parameter")
ORDER_SENSITIVE = ("local", "pattern_variable")
MODULE_SCOPE = ("file", "namespace", "module")
ECMASCRIPT = ("javascript", "jsx", "typescript", "tsx")

DYNAMIC_ATTRIBUTES = ("computed_target", "dynamic_specifier")
DYNAMIC_LIMITATIONS = ("dynamic_property_target_not_resolved", "dynamic_module_specifier_not_resolved", "macro_not_expanded", "jsx_tag_not_a_call_edge")
RECEIVER_LIMITATIONS = (
    "receiver_type_not_inferred", "receiver_type_or_import_prefix_not_inferred", "interface_virtual_or_extension_dispatch_not_resolved",
    "interface_or_virtual_dispatch_not_resolved", "dispatch_target_not_resolved",
)


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def has(attributes: Column, value: str) -> Column:
    return F.array_contains(F.coalesce(attributes, strings()), value)


def attribute(attributes: Column, prefix: str) -> Column:
    """What follows the prefix in the first attribute that begins with it; null if none does."""
    return F.substring(F.get(F.filter(F.coalesce(attributes, strings()), lambda a: a.startswith(prefix)), 0), len(prefix) + 1, 1 << 30)


def any_of(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.coalesce(values, strings()), strings(*wanted))


def is_dynamic(attributes: Column, limitations: Column) -> Column:
    return any_of(attributes, DYNAMIC_ATTRIBUTES) | any_of(limitations, DYNAMIC_LIMITATIONS)


def uncertain_receiver(spelling: Column, receiver: Column, limitations: Column) -> Column:
    return receiver.isNotNull() | spelling.rlike(r"::|\.|/") | any_of(limitations, RECEIVER_LIMITATIONS)


def qualifier(spelling: Column) -> Column:
    """What precedes the last '::', or else '.', or else '/'; null without one."""
    part = lambda sep: F.regexp_extract(spelling, rf"(?s)^(.*){sep}", 1)
    return F.when(spelling.contains("::"), part("::")).when(spelling.contains("."), part(r"\.")).when(spelling.contains("/"), part("/"))


def role_compatible(occurrence: Column, declaration: Column, kind: Column) -> Column:
    """An occurrence in a type place needs a type, one in a value place needs a value."""
    return roles_fit(has(occurrence, "role:type"), has(occurrence, "role:value"), declaration, kind)


def roles_fit(needs_type: Column, needs_value: Column, declaration: Column, kind: Column) -> Column:
    is_type = has(declaration, "role:type") | kind.isin(*TYPE)
    is_value = has(declaration, "role:value") | ~kind.isin(*NO_VALUE)
    return (~needs_type | is_type) & (~needs_value | is_value)


def module_visible(language: Column, attributes: Column, spelling: Column, signature: Column) -> Column:
    return (
        F.when(language.isin(*ECMASCRIPT), has(attributes, "exported"))
        .when(language == "dart", ~spelling.startswith("_"))
        .when(language == "go", spelling.rlike(r"^\p{Lu}"))
        .when(language == "rust", F.coalesce(F.ltrim(signature).startswith("pub "), F.lit(False)))
        .otherwise(F.lit(True))
    )


def combinators_allow(attributes: Column, name: Column) -> Column:
    """Every show: list holds the name, and no hide: list does."""
    listed = lambda a: F.array_contains(F.split(F.substring(a, 6, 1 << 30), ","), name)
    return F.forall(F.coalesce(attributes, strings()), lambda a: F.when(a.startswith("show:"), listed(a)).when(a.startswith("hide:"), ~listed(a)).otherwise(F.lit(True)))


def imported_name(language: Column, attributes: Column, alias: Column, spelling: Column, wanted_qualifier: Column, name: Column) -> Column:
    """The name that an import gives an occurrence (qualifier, name) access to; null if it gives none."""
    imported = attribute(attributes, "imported:")
    bare, last = wanted_qualifier.isNull(), F.regexp_extract(spelling, r"([^.]*)$", 1)
    rust = F.regexp_extract(spelling, r"(?s)([^:]*)$", 1)
    by_alias = F.when(F.coalesce(alias == wanted_qualifier, F.lit(False)) | (alias.isNull() & bare), name)
    return (
        F.when(language.isin(*ECMASCRIPT), F.when(imported == "*", F.when(alias.eqNullSafe(wanted_qualifier), name)).when(bare & (alias == name), imported))
        .when(language == "dart", F.when(combinators_allow(attributes, name), by_alias))
        .when(language == "rust", F.when(bare & (F.coalesce(alias, rust) == name), rust))
        .when(language == "go", F.when(alias.eqNullSafe(wanted_qualifier), name))
        .when(language == "java", F.when(bare & (has(attributes, "wildcard_import") | (last == name)), name))
        .when(language == "csharp", by_alias)
    )


def binding_name(language: Column, attributes: Column, spelling: Column) -> Column:
    """The declaration that an import names by itself; null if it names a whole module."""
    imported = attribute(attributes, "imported:")
    return (
        F.when(language.isin(*ECMASCRIPT), F.when(~imported.isin("*", "<side-effect>"), imported))
        .when(language == "rust", F.regexp_extract(spelling, r"(?s)([^:]*)$", 1))
        .when((language == "java") & ~has(attributes, "wildcard_import"), F.regexp_extract(spelling, r"([^.]*)$", 1))
    )
