"""Masking of personal data as one chain of column expressions; the order of the steps is part of the result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions import vocabulary as v
from chatlake.functions.text import W, matches, replaced, tidy_lines, usual_forms, without_bidi

# The patterns that decide what is masked, in RE2's syntax as the SQL counterparts use them. A word boundary of letters is
# written out, since Java's and RE2's \b differ on letters outside ASCII.
EMAIL = rf"[{W}][{W}.+-]*@[{W}-]+(?:\.[{W}-]+)*\.[{W}-]*[{W}]"
_REST = r"[^\s<>\"'\]\)]"
_ENDINGS = "(?:com|net|org|io|ms|co|dev|tr|me)"
URL = rf"(?i)\b(?:https?://|www\.){_REST}+|\b(?:[a-z0-9-]+\.)+{_ENDINGS}(?:/{_REST}*)?"
PHONE = r"(?:\+[0-9]{1,3}[\s\x{a0}.\-]*)?(?:\(?[0-9]{1,4}\)?[\s\x{a0}.\-]*){1,6}[0-9]{2,10}"
DATE = r"\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b"
HANDLE = rf"(?<![{W}./])@[A-Za-z0-9_.]{{3,32}}"
ROSTER_ROW = r"^\s*\"?[^\t]{1,80}\"?\t+\S+@\S+\s*$"
CONTACT = r"[^\s<>]+(?:\s+[^\s<>]+){0,3}\s*<\s*\S+@\S+\s*>"

# The same matches for Java, which walks back over groups by recursion and from every start: here groups are possessive, and a start from which
# an earlier one would have gone the same way is left out.
#: A run of the local part's characters that is no address and long is taken whole, to be put back as it is; marks before an address too.
JAVA_EMAIL = rf"[.+-]*+[{W}][{W}.+-]*+@[{W}-]++(?:-*+(?:\.-++(?=\.))*+\.[{W}-]*[{W}])++|[{W}.+-]{{40,}}+"
#: A host goes on as far as a label that is followed by a listed ending; labels of the same host before it cannot start one again.
_SAME_HOST = r"(?<!\b[a-z0-9]{1,200}-{0,64}\.?)"
JAVA_URL = rf"(?i)\b(?:https?://|www\.){_REST}+|\b{_SAME_HOST}(?:(?:[a-z0-9-]++\.(?!{_ENDINGS}))*+[a-z0-9-]++\.(?={_ENDINGS}))++{_ENDINGS}(?:/{_REST}*)?"
JAVA_CONTACT = r"(?<![^\s<>])[^\s<>]++(?:\s++[^\s<>]++){0,3}+\s*+<\s*\S+@\S+\s*>"
KINDS = ("roster_row", "contact_card", "official_email", "email", "private_url", "phone", "handle")


@dataclass(frozen=True)
class MaskingPolicy:
    emails: bool = True
    phones: bool = True
    urls: bool = True
    handles: bool = True
    rosters: bool = True
    senders: bool = True
    official_domains: tuple[str, ...] = v.OFFICIAL_DOMAINS
    documentation_domains: tuple[str, ...] = v.DOCUMENTATION_DOMAINS
    public_hosts: tuple[str, ...] = v.PUBLIC_HOSTS
    private_hosts: tuple[str, ...] = v.PRIVATE_HOSTS
    kept_mentions: tuple[str, ...] = v.KEPT_MENTIONS
    salt: str = "chatlake"

    def with_private_hosts(self, *hosts: str) -> MaskingPolicy:
        return replace(self, private_hosts=(*self.private_hosts, *(h.strip().lower() for h in hosts if h.strip())))

    @property
    def complete(self) -> bool:
        return self.emails and self.phones and self.urls and self.handles and self.rosters and self.senders


def _under(host: Column, domains: Iterable[str]) -> Column:
    """Whether ``host`` is one of the domains or below one."""
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def host_of(url: Column) -> Column:
    bare = F.regexp_replace(url, r"(?i)^https?://", "")
    return F.regexp_replace(F.lower(F.substring_index(F.substring_index(bare, "/", 1), "?", 1)), r"^www\.", "")


def is_public_host(host: Column, policy: MaskingPolicy = MaskingPolicy()) -> Column:
    return ~_under(host, policy.private_hosts) & _under(host, policy.public_hosts + policy.documentation_domains)


def email_kind(email: Column, policy: MaskingPolicy) -> Column:
    """The kind of a match of ``JAVA_EMAIL``; null for what stays as it is."""
    domain = F.lower(F.substring_index(email, "@", -1))
    return (
        F.when(~F.contains(email, F.lit("@")) | domain.isin(*policy.documentation_domains), F.lit(None).cast("string"))
        .when(_under(domain, policy.official_domains), F.lit("official_email"))
        .otherwise(F.lit("email"))
    )


def _is_kind(kind: str, policy: MaskingPolicy):
    return lambda m: email_kind(m, policy) == kind


def is_phone(candidate: Column) -> Column:
    digits = F.char_length(F.regexp_replace(candidate, "[^0-9]", ""))
    return digits.between(10, 15) & ~candidate.rlike(DATE) & (candidate.rlike(r"[\s\x{a0}.\-]") | candidate.startswith("+"))


def _counted(found: Column, test) -> Column:
    return F.size(F.filter(found, test))


# Cheap tests that hold for every text in which the step can find something.
HINTS = {
    "rosters": lambda t: F.contains(t, F.lit("\t")) & F.contains(t, F.lit("@")), "contacts": lambda t: F.contains(t, F.lit("<")) & F.contains(t, F.lit("@")), "emails": lambda t: F.contains(t, F.lit("@")),
    "urls": lambda t: t.rlike(r"(?i)://|www\.|\.(?:com|net|org|io|ms|co|dev|tr|me)"), "phones": lambda t: t.rlike("[0-9]"), "handles": lambda t: F.contains(t, F.lit("@")),
}


def mask_rosters(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    row = lambda x: x.rlike(ROSTER_ROW)
    marked = F.transform(lines, lambda x, i: F.when(~row(x), x).when((i > 0) & row(F.get(lines, i - 1)), F.lit(None)).otherwise(F.lit(v.ROSTER_MARK)))
    return F.when(HINTS["rosters"](text), F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")).otherwise(text)


def mask_contacts(text: Column) -> Column:
    return F.when(HINTS["contacts"](text), F.regexp_replace(text, JAVA_CONTACT, v.ROSTER_MARK.replace("[", r"\[").replace("]", r"\]"))).otherwise(text)


def mask_emails(text: Column, policy: MaskingPolicy = MaskingPolicy()) -> Column:
    def put(m: Column) -> Column:
        kind, before = email_kind(m, policy), F.regexp_extract(m, r"^[.+-]*+", 0)
        mark = F.when(kind == "email", F.lit(v.EMAIL_MARK)).when(kind == "official_email", F.lit(v.OFFICIAL_EMAIL_MARK))
        return F.when(mark.isNotNull(), F.concat(before, mark)).otherwise(m)

    return replaced(text, JAVA_EMAIL, put, HINTS["emails"](text))


def mask_urls(text: Column, policy: MaskingPolicy = MaskingPolicy()) -> Column:
    return replaced(text, JAVA_URL, lambda m: F.when(is_public_host(host_of(m), policy), m).otherwise(F.lit(v.URL_MARK)), HINTS["urls"](text))


def mask_phones(text: Column) -> Column:
    tail = lambda m: F.regexp_extract(m, r"[.\-\s\x{a0}]+$", 0)
    return replaced(text, PHONE, lambda m: F.when(is_phone(m), F.concat(F.lit(v.PHONE_MARK), tail(m))).otherwise(m), HINTS["phones"](text))


def mask_handles(text: Column, policy: MaskingPolicy = MaskingPolicy()) -> Column:
    return replaced(text, HANDLE, lambda m: F.when(F.lower(F.substring(m, 2, 40)).isin(*policy.kept_mentions), m).otherwise(F.lit(v.HANDLE_MARK)), HINTS["handles"](text))


def masked_steps(policy: MaskingPolicy) -> list[tuple[str, bool, object, object]]:
    """Name of the step, whether it is on, text after it, counts by kind from the text before it."""
    return [
        ("rosters", policy.rosters, mask_rosters, lambda t: {"roster_row": _counted(F.split(t, "\n", -1), lambda x: x.rlike(ROSTER_ROW))}),
        ("contacts", policy.rosters, mask_contacts, lambda t: {"contact_card": F.size(matches(t, JAVA_CONTACT))}),
        ("emails", policy.emails, lambda t: mask_emails(t, policy), lambda t: {k: _counted(matches(t, JAVA_EMAIL), _is_kind(k, policy)) for k in ("official_email", "email")}),
        ("urls", policy.urls, lambda t: mask_urls(t, policy), lambda t: {"private_url": _counted(matches(t, JAVA_URL), lambda m: ~is_public_host(host_of(m), policy))}),
        ("phones", policy.phones, mask_phones, lambda t: {"phone": _counted(matches(t, PHONE), is_phone)}),
        (
            "handles", policy.handles, lambda t: mask_handles(t, policy),
            lambda t: {"handle": _counted(matches(t, HANDLE), lambda m: ~F.lower(F.substring(m, 2, 40)).isin(*policy.kept_mentions))},
        ),
    ]


def with_masked(df, column: str = "text", into: str = "masked", counts: str | None = "masked_counts", policy: MaskingPolicy = MaskingPolicy()):
    """``df`` with the masked text and a struct of counts by kind.

    Each step is a column of its own, so no expression is evaluated twice and plans stay flat.
    """
    out, at, kept, found = df, "__m0", df.columns, {k: F.lit(0) for k in KINDS}
    out = out.withColumn(at, without_bidi(F.col(column)))
    for n, (name, on, step, count) in enumerate(masked_steps(policy)):
        if on:
            for k, c in count(F.col(at)).items():
                out = out.withColumn(f"__n_{k}", F.when(HINTS[name](F.col(at)), c).otherwise(0))
                found[k] = F.col(f"__n_{k}")
            out = out.withColumn(f"__m{n + 1}", step(F.col(at)))
            at = f"__m{n + 1}"
    total = F.struct(*[found[k].cast("int").alias(k) for k in KINDS])
    keep = [F.col(c) for c in kept if c not in (into, counts)]
    # One-element explode: a filter on the masked text must not be pushed below, where it would repeat every step's expression.
    done = F.struct(tidy_lines(F.col(at)).alias("t"), *([total.alias("n")] if counts else []))
    out = out.select(*keep, F.explode(F.array(done)).alias("__done"))
    return out.select(*keep, F.col("__done.t").alias(into), *([F.col("__done.n").alias(counts)] if counts else []))


def total_of(counts: str) -> Column:
    return sum((F.col(f"{counts}.{k}") for k in KINDS), F.lit(0))


def pseudonym(sender: Column, policy: MaskingPolicy = MaskingPolicy()) -> Column:
    if not policy.senders:
        return sender
    name = F.lower(F.trim(usual_forms(without_bidi(sender))))
    return F.concat(F.lit("Katılımcı#"), F.substring(F.sha2(F.concat(F.lit(policy.salt + ":"), name), 256), 1, 4))


def group_label(chat_id: Column, policy: MaskingPolicy = MaskingPolicy()) -> Column:
    return F.concat(F.lit("Grup#"), F.substring(F.sha2(F.concat(F.lit(policy.salt + ":chat:"), chat_id.cast("string")), 256), 1, 4))


def redact_aliases(text: Column, aliases: Iterable[str], label: str = "Eğitmen") -> Column:
    """Names of at least three characters, the longest first, replaced whatever their case."""
    out = text
    for alias in sorted({a.strip() for a in aliases if len(a.strip()) >= 3}, key=lambda a: (-len(a), a)):
        out = F.regexp_replace(out, r"(?iu)\Q" + alias + r"\E", label)
    return out


def safe_error(text: Column, length: int = 240) -> Column:
    """Without URLs, tokens and control characters, single spaced and cut."""
    out = F.regexp_replace(text, r"(?i)https?://\S+", "[redacted-url]")
    out = F.regexp_replace(out, r"(?i)\b(?:bot)?[0-9]{6,}:[A-Za-z0-9_-]{20,}\b", "[redacted-token]")
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]+", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, length)
