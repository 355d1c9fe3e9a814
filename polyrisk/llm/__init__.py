"""Operators for preparing large text corpora (standalone; nothing else imports it)."""
