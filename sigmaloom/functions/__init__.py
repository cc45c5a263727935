"""Part of sigmaloom; see the README for the layout."""
