"""Column expressions that classify answers and responses.

Each returns the error message to store, or null when the row goes on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from midyear import constants as K

ANSWER_SCHEMA = "archived_snapshots struct<closest: struct<url: string>>"


def answer_url(body: Column) -> Column:
    """Capture URL in an availability answer; null for any other body."""
    return F.from_json(body, ANSWER_SCHEMA)["archived_snapshots"]["closest"]["url"]


def answer_error(body: Column, website: Column, query_url: Column) -> Column:
    return F.when(
        body.isNull(), F.concat(F.lit(K.URL_NOT_FOUND), website, F.lit(K.URL_NOT_FOUND_QUERY), query_url)
    ).when(
        answer_url(body).isNull(),
        F.concat(
            F.lit(K.ANSWER_UNUSABLE), website, F.lit(K.ANSWER_QUERY), query_url, F.lit(K.ANSWER_BODY), body
        ),
    )


def is_throttled(status: Column, final_url: Column) -> Column:
    return F.coalesce((status == 200) & (final_url == K.THROTTLE_PAGE), F.lit(False))


def transport_failure(status: Column, transport_error: Column) -> Column:
    """The error text of a fetch without response; null if there is one."""
    return F.when(status.isNull(), F.coalesce(transport_error, F.lit(K.NOT_STORED)))


def homepage_error(status: Column, final_url: Column, transport_error: Column) -> Column:
    failure = transport_failure(status, transport_error)
    return (
        F.when(failure.isNotNull(), failure)
        .when(is_throttled(status, final_url), F.concat(F.lit(K.HOMEPAGE_THROTTLED), final_url))
        .when(status != 200, F.concat(F.lit(K.HOMEPAGE_STATUS), status.cast("string")))
    )


def page_error(status: Column, final_url: Column, transport_error: Column) -> Column:
    failure = transport_failure(status, transport_error)
    return (
        F.when(failure.isNotNull(), F.concat(F.lit(K.PAGE_TRANSPORT), failure))
        .when(is_throttled(status, final_url), F.concat(F.lit(K.HOMEPAGE_THROTTLED), final_url))
        .when(status != 200, F.concat(F.lit(K.PAGE_STATUS), status.cast("string")))
    )


def is_text(content_type: Column) -> Column:
    """A missing content type counts as text."""
    return content_type.isNull() | content_type.rlike(K.TEXT_CONTENT_TYPES)


def content_error(status: Column, final_url: Column, content_type: Column) -> Column:
    """For a homepage or a re-run page whose content type is not text."""
    return F.when(
        ~is_text(content_type),
        F.concat(
            F.lit(K.CONTENT_REJECTED), final_url, F.lit(K.CONTENT_REJECTED_STATUS), status.cast("string")
        ),
    )


def link_error(
    status: Column, final_url: Column, transport_error: Column, content_type: Column, strict_status: bool = False
) -> Column:
    """For a link of a walk: any response counts as opened unless ``strict_status``."""
    failure = transport_failure(status, transport_error)
    message = F.when(failure.isNotNull(), failure)
    if strict_status:
        message = message.when(
            (status != 200) | is_throttled(status, final_url), F.concat(F.lit(K.LINK_STATUS), status.cast("string"))
        )
    return message.when(
        ~is_text(content_type), F.concat(F.lit(K.LINK_CONTENT_REJECTED), status.cast("string"))
    )
