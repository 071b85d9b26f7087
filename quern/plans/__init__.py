"""Registered queries: ``catalog`` holds those written as SQL, ``frames`` those that use the library's operators."""
