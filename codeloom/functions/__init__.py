"""Column functions."""

from .identifiers import declaration_site, ident_multiplier, is_test_file, stem, subtokens, subtokens_of, tier, token_estimate
from .paths import ancestors, basename, extension, feature_of, normalize_url, route_segment, url_of

__all__ = ["ancestors", "basename", "declaration_site", "extension", "feature_of", "ident_multiplier", "is_test_file", "normalize_url", "route_segment", "stem", "subtokens", "subtokens_of", "tier", "token_estimate", "url_of"]
