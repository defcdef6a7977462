"""Review files from the web, off unless it is called: https only, named hosts, public addresses, bounded redirects and bytes."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterable
from urllib.parse import urljoin, urlsplit

MAX_REDIRECTS, MAX_BYTES = 5, 64 << 20


def addresses(host: str) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(host, 443, proto=socket.IPPROTO_TCP)})


def allowed(url: str, hosts: Iterable[str], resolve: Callable[[str], list[str]] = addresses) -> str:
    """The host of an address that may be fetched: https, no user or other port, a named host, and only public addresses behind it."""
    parts = urlsplit(url)
    if parts.scheme != "https" or parts.username or parts.password or parts.port not in (None, 443):
        raise ValueError("only plain https addresses are fetched")
    host = (parts.hostname or "").lower()
    if host not in {h.lower() for h in hosts}:
        raise ValueError(f"{host or 'an empty host'} isn't among the hosts that may be asked")
    found = resolve(host)
    if not found or not all(ipaddress.ip_address(a).is_global for a in found):
        raise ValueError(f"{host} isn't at a public address")
    return host


def fetched(url: str, hosts: Iterable[str], transport: Callable[[str], tuple[int, dict, Iterable[bytes]]], resolve: Callable[[str], list[str]] = addresses, most: int = MAX_BYTES) -> bytes:
    """The body behind url. transport(url) -> (status, headers with lower-case names, pieces of the body) sends no cookies or credentials and follows no redirects itself."""
    hosts = tuple(hosts)
    for _ in range(MAX_REDIRECTS + 1):
        allowed(url, hosts, resolve)
        status, headers, pieces = transport(url)
        if status in (301, 302, 303, 307, 308):
            if not headers.get("location"):
                raise ValueError("a redirect without a target")
            url = urljoin(url, headers["location"])
            continue
        if status != 200:
            raise ValueError(f"the server answered {status}")
        if int(headers.get("content-length") or 0) > most:
            raise ValueError("the file is too large")
        out = bytearray()
        for piece in pieces:
            out += piece
            if len(out) > most:
                raise ValueError("the file is too large")
        return bytes(out)
    raise ValueError("too many redirects")
