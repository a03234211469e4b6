"""Set-based operators over versioned documents."""
