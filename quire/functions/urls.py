"""URL functions: X1 normalisation, X2 validity, X3 domain, X4 title from URL, X6 content type."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd

from .udfs import arrow_udf

# Query parameters that only track clicks.
TRACKING = frozenset(
    """
    utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format utm_marketing_tactic
    fbclid fb_action_ids fb_action_types fb_source fb_ref
    gclid gclsrc dclid
    twclid
    msclkid
    hsa_acc hsa_cam hsa_grp hsa_ad hsa_src hsa_tgt hsa_kw hsa_mt hsa_net hsa_ver
    mc_cid mc_eid
    ref source campaign medium
    """.split()
)
# Hosts of social and of video pages.
SOCIAL = ("instagram.com", "twitter.com", "x.com", "threads.net", "facebook.com", "tiktok.com", "reddit.com", "linkedin.com", "pinterest.com", "snapchat.com", "tumblr.com", "mastodon.social", "bsky.app")
VIDEO = ("youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "dailymotion.com", "wistia.com")


def normal(url: str | None) -> str | None:
    """Lower scheme and host, no trailing slashes, no tracking parameters, the others by key, no fragment; None for
    what is no URL at all."""
    if url is None:
        return None
    try:
        at = urlsplit(url.strip())
    except ValueError:  # such as a bracket that opens no address
        return None
    kept = [(k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if k.lower() not in TRACKING]
    return urlunsplit((at.scheme.lower(), at.netloc.lower(), at.path.rstrip("/"), urlencode(sorted(kept, key=lambda kv: kv[0])), ""))


@arrow_udf("string")
def normalize_url(urls: pd.Series) -> pd.Series:
    return urls.map(normal)


def _split(url: str):
    try:
        return urlsplit(url)
    except ValueError:
        return urlsplit("")


def host_of(url: str) -> str:
    return _split(url).netloc.lower()


def title_of(url: str) -> str:
    """The last path segment without extension, dashes as spaces, words capitalised; empty for a broken URL."""
    name = unquote(_split(url).path.rstrip("/").rsplit("/", 1)[-1])
    return re.sub(r"[-_]+", " ", name.rsplit(".", 1)[0] if "." in name[1:] else name).strip().title()


@arrow_udf("string")
def title_from_url(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else title_of(u))


def content_type(url: str, header: str | None = None) -> str:
    """Header PDF, URL PDF, header video, video host, social host, else article."""
    host = host_of(url).split(":")[0]
    path = url.split("?")[0].lower()
    head = (header or "").lower()

    def at(hosts: tuple[str, ...]) -> bool:
        return any(host == h or host.endswith("." + h) for h in hosts)

    if "application/pdf" in head or path.endswith(".pdf") or "/pdf/" in path:
        return "pdf"
    if head.startswith("video/") or at(VIDEO):
        return "video"
    return "tweet" if at(SOCIAL) else "article"


@arrow_udf("string")
def detect_content_type(urls: pd.Series, headers: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else content_type(u, h) for u, h in zip(urls, headers, strict=True)], dtype="object")
