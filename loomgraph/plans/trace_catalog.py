"""The built-in workflow traces."""

from __future__ import annotations

from .trace import SubFlow, Trace

# Ids, names and icons; patterns (regular expressions over names, whatever their case) and tags of entries
# and exits; edge kinds; node types.
CATALOG = (
    Trace("auth", "Authentication Flow", icon="🔐", description="How users sign in and out, and what tokens, sessions and guarded routes do meanwhile", sub_flows=(
        SubFlow(
            "auth-login", "Login Flow",
            entry_patterns=("login", "signin", "sign.in", "LoginScreen", "SignInScreen", "LoginForm"), entry_tags=("auth", "auth-consumer", "form-consumer"),
            exit_patterns=("token", "session", "setToken", "setSession", "storeToken", "saveToken", "isAuthenticated"), exit_tags=("auth-storage", "auth-token", "state-mutation"),
            edge_kinds=("import", "call", "jsx", "api_call", "navigates_to", "uses_context", "storage_access", "dispatches"),
            types=("screen", "component", "hook", "service", "api", "endpoint", "store", "function"),
        ),
        SubFlow(
            "auth-logout", "Logout Flow",
            entry_patterns=("logout", "signout", "sign.out", "SignOut", "log.out"), entry_tags=("auth",),
            exit_patterns=("login", "signin", "removeToken", "clearToken", "clearSession", "removeItem.*token"), exit_tags=("auth-storage", "auth-token"),
            edge_kinds=("import", "call", "api_call", "navigates_to", "storage_access", "dispatches"),
            types=("screen", "component", "hook", "service", "api", "store", "function"),
        ),
        SubFlow(
            "auth-token-refresh", "Token Refresh Flow",
            entry_patterns=("refreshToken", "tokenRefresh", "interceptor", "onUnauthorized", "401"), entry_tags=("auth-token", "auth-api"),
            exit_patterns=("setToken", "retry", "newToken"), exit_tags=("auth-storage", "auth-token"),
            edge_kinds=("import", "call", "api_call", "storage_access", "dispatches"),
            types=("hook", "service", "api", "endpoint", "store", "function"),
        ),
        SubFlow(
            "auth-protected-route", "Protected Route Flow",
            entry_patterns=("ProtectedRoute", "AuthGuard", "PrivateRoute", "RequireAuth", "AuthenticatedRoute", "AuthenticatedScreen"), entry_tags=("auth-guard",),
            exit_patterns=("login", "signin", "navigate.*login", "isAuthenticated", "redirect"), exit_tags=("auth-consumer", "auth-check"),
            edge_kinds=("import", "call", "jsx", "navigates_to", "uses_context"),
            types=("screen", "component", "hook", "function"),
        ),
        SubFlow(
            "auth-signup", "Signup / Registration Flow",
            entry_patterns=("signup", "register", "sign.up", "RegisterScreen", "CreateAccount"), entry_tags=("auth", "form-consumer"),
            exit_patterns=("verify", "confirm", "onboard", "welcome", "success"), exit_tags=("auth-consumer",),
            edge_kinds=("import", "call", "jsx", "api_call", "navigates_to", "storage_access"),
            types=("screen", "component", "hook", "service", "api", "endpoint", "function"),
        ),
        SubFlow(
            "auth-password-reset", "Password Reset Flow",
            entry_patterns=("forgotPassword", "resetPassword", "changePassword", "ForgotPassword"), entry_tags=("auth",),
            exit_patterns=("login", "success", "changed", "updated"), exit_tags=("auth-consumer",),
            edge_kinds=("import", "call", "jsx", "api_call", "navigates_to"),
            types=("screen", "component", "hook", "service", "api", "endpoint", "function"),
        ),
    )),
    Trace("navigation", "Navigation Flow", icon="🧭", description="How users move between screens, by action or by link", sub_flows=(
        SubFlow(
            "nav-screen-flow", "Screen Navigation Flow",
            entry_patterns=("navigation", "navigate", "useNavigation", "onPress", "handlePress", "goTo"), entry_tags=("navigation", "navigation-consumer", "nav-action"),
            exit_patterns=("screen", "page", "mount", "useEffect", "loadData", "fetchData"),
            edge_kinds=("import", "call", "navigates_to", "defines_route", "jsx"),
            types=("screen", "component", "hook", "function"),
        ),
        SubFlow(
            "nav-deep-link", "Deep Link Flow",
            entry_patterns=("deepLink", "Linking", "useURL", "universalLink", "scheme"), entry_tags=("deep-link",),
            exit_patterns=("screen", "navigate", "handleURL", "processURL"), exit_tags=("navigation",),
            edge_kinds=("import", "call", "deep_link", "navigates_to", "jsx"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
    Trace("data-fetch", "Data Fetching Flow", icon="📡", description="How views get and change remote data", sub_flows=(
        SubFlow(
            "data-query", "Query / Data Loading Flow",
            entry_patterns=("useQuery", "useFetch", "useApi", "useData", "fetchData", "getData", "loadData"), entry_tags=("state-consumer",),
            exit_patterns=("api", "endpoint", "fetch", "axios", "loading", "error", "success"), exit_tags=("api-import",),
            edge_kinds=("import", "call", "api_call", "references"),
            types=("screen", "component", "hook", "service", "api", "endpoint", "function"),
        ),
        SubFlow(
            "data-mutation", "Mutation / Data Writing Flow",
            entry_patterns=("useMutation", "postData", "createData", "updateData", "deleteData", "submitForm"), entry_tags=("state-consumer",),
            exit_patterns=("api", "endpoint", "invalidate", "refetch", "optimistic"),
            edge_kinds=("import", "call", "api_call", "dispatches"),
            types=("screen", "component", "hook", "service", "api", "endpoint", "store", "function"),
        ),
    )),
    Trace("state", "State Management Flow", icon="🗄️", description="How stores are made, changed and read", sub_flows=(
        SubFlow(
            "state-store-creation", "Store Creation Flow",
            entry_patterns=("createStore", "createSlice", "configureStore", r"create\(", "zustand"), entry_tags=("state-store", "state-slice"),
            exit_patterns=("export", "selector", "useStore", "useSelector"), exit_tags=("state-consumer",),
            edge_kinds=("import", "call", "dispatches", "references"),
            types=("store", "hook", "service", "function"),
        ),
        SubFlow(
            "state-dispatch", "Action Dispatch Flow",
            entry_patterns=("dispatch", "handleClick", "onPress", "handleAction"), entry_tags=("state-mutation",),
            exit_patterns=("reducer", "update", "set", "state", "useSelector"), exit_tags=("state-consumer",),
            edge_kinds=("import", "call", "dispatches", "uses_context"),
            types=("screen", "component", "hook", "store", "function"),
        ),
    )),
    Trace("forms", "Form Handling Flow", icon="📝", description="How forms check and send what users type", sub_flows=(
        SubFlow(
            "form-submit", "Form Submission Flow",
            entry_patterns=("useForm", "useFormik", "Formik", "handleSubmit", "onSubmit", "useField"), entry_tags=("form", "form-consumer", "form-component"),
            exit_patterns=("api", "submit", "success", "error", "mutation", "post"),
            edge_kinds=("import", "call", "api_call", "dispatches", "jsx"),
            types=("screen", "component", "hook", "service", "api", "function"),
        ),
        SubFlow(
            "form-validation", "Form Validation Flow",
            entry_patterns=("validate", "validation", "schema", "yup", "zod", "rules"), entry_tags=("form",),
            exit_patterns=("error", "errors", "isValid", "invalid", "touched"),
            edge_kinds=("import", "call", "references"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
    Trace("payment", "Payment Flow", icon="💳", description="How an order is paid", sub_flows=(
        SubFlow(
            "payment-checkout", "Checkout Flow",
            entry_patterns=("payment", "checkout", "purchase", "billing", "cart", "order", "CartScreen", "CheckoutScreen"),
            exit_patterns=("confirm", "receipt", "success", "webhook", "stripe", "charge", "complete"), exit_tags=("payment-api",),
            edge_kinds=("import", "call", "jsx", "api_call", "storage_access", "dispatches"),
            types=("screen", "component", "hook", "service", "api", "endpoint", "store", "function"),
        ),
    )),
    Trace("errors", "Error Handling Flow", icon="⚠️", description="How errors are caught, reported and shown", sub_flows=(
        SubFlow(
            "error-boundary", "Error Boundary Flow",
            entry_patterns=("ErrorBoundary", "componentDidCatch", "catch", "try", "ErrorFallback"), entry_tags=("error",),
            exit_patterns=("sentry", "crashlytics", "report", "log", "analytics", "fallback", "ErrorScreen"),
            edge_kinds=("import", "call", "references", "jsx"),
            types=("screen", "component", "hook", "service", "class", "function"),
        ),
    )),
    Trace("storage", "Data Storage Flow", icon="💾", description="What is kept on the device, and how", sub_flows=(
        SubFlow(
            "storage-persist", "Data Persistence Flow",
            entry_patterns=("AsyncStorage", "SecureStore", "localStorage", "MMKV", "persist", "rehydrate"), entry_tags=("storage", "secure-storage"),
            exit_patterns=("getItem", "setItem", "removeItem", "clearAll", "save", "load"),
            edge_kinds=("import", "call", "storage_access", "dispatches"),
            types=("screen", "component", "hook", "store", "service", "function"),
        ),
    )),
    Trace("realtime", "Real-time / WebSocket Flow", icon="⚡", description="How live messages come in and go out", sub_flows=(
        SubFlow(
            "realtime-websocket", "WebSocket Connection Flow",
            entry_patterns=("WebSocket", r"socket\.io", "useWebSocket", "useSocket", "connectSocket", "realtime"), entry_tags=("realtime",),
            exit_patterns=("onMessage", "sendMessage", "subscribe", "unsubscribe", "disconnect", "update"),
            edge_kinds=("import", "call", "emits_event", "subscribes_event", "dispatches"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
    Trace("permissions", "Permission Flow", icon="🔒", description="How leave is asked for and what follows", sub_flows=(
        SubFlow(
            "permission-request", "Permission Request Flow",
            entry_patterns=("checkPermission", "requestPermission", "usePermission", "hasPermission", "camera", "location", "notification.*permission"), entry_tags=("permission", "permission-request"),
            exit_patterns=("granted", "denied", "blocked", "openSettings", "fallback"),
            edge_kinds=("import", "call", "navigates_to"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
    Trace("notifications", "Push Notification Flow", icon="🔔", description="How pushed messages reach a screen", sub_flows=(
        SubFlow(
            "notification-push", "Push Notification Flow",
            entry_patterns=("PushNotification", "registerForPush", "usePushNotification", "FCM", "OneSignal", "Notifee", "RemoteMessage"), entry_tags=("notification", "notification-consumer"),
            exit_patterns=("navigate", "screen", "handleNotification", "onNotification", "display"), exit_tags=("navigation",),
            edge_kinds=("import", "call", "navigates_to", "api_call"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
    Trace("analytics", "Analytics Tracking Flow", icon="📊", description="How what users do is recorded", sub_flows=(
        SubFlow(
            "analytics-tracking", "Event Tracking Flow",
            entry_patterns=("analytics", "track", "trackEvent", "logEvent", "identify", "screenView", "FirebaseAnalytics", "Mixpanel", "Amplitude"), entry_tags=("analytics",),
            exit_patterns=("report", "send", "flush", "batch", "upload"),
            edge_kinds=("import", "call", "tracks_event"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
    Trace("onboarding", "Onboarding Flow", icon="🎯", description="What new users see first", sub_flows=(
        SubFlow(
            "onboarding-welcome", "Onboarding Steps Flow",
            entry_patterns=("onboard", "welcome", "getting.started", "tutorial", "setup", "intro", "WelcomeScreen"),
            exit_patterns=("complete", "finish", "done", "dashboard", "home", "main", "MainScreen"),
            edge_kinds=("import", "call", "jsx", "navigates_to", "storage_access"),
            types=("screen", "component", "hook", "store", "function"),
        ),
    )),
    Trace("theme", "Theme / Dark Mode Flow", icon="🎨", description="How colours and styles are chosen", sub_flows=(
        SubFlow(
            "theme-switch", "Theme Switching Flow",
            entry_patterns=("ThemeProvider", "useTheme", "useColorScheme", "darkMode", "toggleTheme", "Appearance"), entry_tags=("theme",),
            exit_patterns=("style", "color", "background", "render"),
            edge_kinds=("import", "call", "uses_context", "storage_access"),
            types=("screen", "component", "hook", "store", "function"),
        ),
    )),
    Trace("i18n", "Internationalization Flow", icon="🌍", description="How texts are put into the user's language", sub_flows=(
        SubFlow(
            "i18n-translate", "Translation Flow",
            entry_patterns=("useTranslation", "i18n", "translate", "localize", "formatMessage", "LanguageProvider", "setLocale"), entry_tags=("i18n",),
            exit_patterns=("render", "text", "display", "switch"),
            edge_kinds=("import", "call", "uses_context"),
            types=("screen", "component", "hook", "service", "function"),
        ),
    )),
)


def builtin() -> list[Trace]:
    return list(CATALOG)
