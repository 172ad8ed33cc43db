"""DataFrame operators over pages, PDF texts, attempts and audit logs."""
