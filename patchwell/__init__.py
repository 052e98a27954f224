"""DataFrame jobs for package drift, patch classification and training-data preparation."""
